"""Shared by the operators on embeddings: which vectors count, and tables of packed blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, fine)


def packed(rows: DataFrame, keys: list[str], ident: str, vector: str) -> DataFrame:
    """One row for each group of ``keys``: ``n``, ``idents`` and ``matrix`` as bytes of longs and doubles, in order of ident.

    The caller bounds the size of a group.
    """
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(ident)
        matrix = np.stack(group[vector].to_numpy()).astype("<f8") if len(group) else np.empty((0, 0))
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "n": [len(group)],
                             "idents": [group[ident].to_numpy("<i8").tobytes()], "matrix": [matrix.tobytes()]})

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, idents binary, matrix binary"
    return rows.select(*keys, ident, F.col(vector).cast("array<double>").alias(vector)).groupBy(*keys).applyInPandas(pack, schema)


def unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Idents and matrix of a packed row."""
    return np.frombuffer(row["idents"], "<i8"), np.frombuffer(row["matrix"], "<f8").reshape(row["n"], -1)
