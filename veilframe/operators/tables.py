"""De-identifying tables column by column, and cells as a long table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.retention import Retention
from veilframe.operators.codes import coded_in_row
from veilframe.operators.detect import items_of
from veilframe.operators.redact import redacted_text
from veilframe.operators.rules import Rule


def text_columns(table: DataFrame) -> list[str]:
    return [f.name for f in table.schema.fields if isinstance(f.dataType, StringType)]


def cells_of(table: DataFrame, key: str) -> DataFrame:
    """The text cells of a table as (key, col, column, text); numbers are no text cells."""
    names = [c for c in text_columns(table) if c != key]
    numbers = F.create_map(*[x for n, c in enumerate(names, start=1) for x in (F.lit(c), F.lit(n))])
    long = table.select(key, *names).unpivot([key], names, "column", "text")
    return long.where("text is not null and text <> ''").withColumn("col", F.element_at(numbers, F.col("column")))


def redact_table(table: DataFrame, rules: Iterable[Rule] | None = None, style: str = "label", mode: str = "hide",
                 overrides: dict[str, Retention] | None = None, columns: Iterable[str] | None = None,
                 key: str | None = None, secret: str | None = None) -> DataFrame:
    """The same table with the values inside its text columns replaced.

    Every cell is its own text. With style ``code`` the codes are unique per
    row key and column, and ``key`` and ``secret`` are required.
    """
    rules = None if rules is None else list(rules)
    chosen = list(columns) if columns is not None else [c for c in text_columns(table) if c != key]
    if style == "code" and (key is None or secret is None):
        raise ValueError("style 'code' needs a key column and a secret")
    at = {c: f"_items_{n}" for n, c in enumerate(chosen)}
    # One step after the other keeps each expression shallow enough for the analyzer.
    out = table.withColumns({at[c]: items_of(F.coalesce(F.col(c), F.lit("")), rules, mode, overrides) for c in chosen})
    if style == "code":
        scope = lambda c: F.concat_ws("/", F.col(key).cast("string"), F.lit(c))
        out = out.withColumns({at[c]: coded_in_row(F.col(at[c]), scope(c), secret) for c in chosen})
    done = out.withColumns({c: F.when(F.col(c).isNotNull(), redacted_text(F.col(c), F.col(at[c]), style)) for c in chosen})
    return done.select(*table.columns)
