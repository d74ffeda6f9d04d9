"""Whole jobs built from the operators."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from veilframe.functions.retention import Retention
from veilframe.operators.codes import code_per_document, code_shared
from veilframe.operators.detect import detect
from veilframe.operators.redact import mapping_per_document, mapping_shared, redact
from veilframe.operators.rules import Rule
from veilframe.session import materialize


class Deidentified(NamedTuple):
    documents: DataFrame
    mapping: DataFrame | None


def deidentify(docs: DataFrame, key: str = "doc_id", rules: Iterable[Rule] | None = None, style: str = "code",
               mode: str = "hide", overrides: dict[str, Retention] | None = None, secret: str | None = None,
               text: str = "text") -> DataFrame:
    """Documents with ``items`` and ``redacted``. One pass over the text, no shuffle."""
    found = detect(docs, rules, text, mode, overrides)
    if style == "code":
        if not secret:
            raise ValueError("style 'code' needs a secret")
        found = code_per_document(found, key, secret)
    return redact(found, style, text)


def deidentify_with_mapping(docs: DataFrame, key: str = "doc_id", rules: Iterable[Rule] | None = None,
                            mode: str = "hide", overrides: dict[str, Retention] | None = None, *, secret: str,
                            text: str = "text") -> Deidentified:
    """Codes per document, with the mapping table; detection runs once, its result is kept as a table."""
    done = materialize(deidentify(docs, key, rules, "code", mode, overrides, secret, text), "deidentified")
    return Deidentified(done, mapping_per_document(done, key))


def deidentify_shared(docs: DataFrame, key: str = "doc_id", rules: Iterable[Rule] | None = None, mode: str = "hide",
                      overrides: dict[str, Retention] | None = None, *, secret: str, scope: Column | None = None,
                      imported: DataFrame | None = None, text: str = "text") -> Deidentified:
    """Codes shared by a batch, optionally continued from an earlier mapping table.

    The detected documents are kept as a table: giving out codes reads only
    the items column of it.
    """
    found = materialize(detect(docs, rules, text, mode, overrides), "detected")
    coded, _ = code_shared(found, key, secret, scope, imported)
    return Deidentified(redact(coded, "code", text), mapping_shared(coded, key, scope))
