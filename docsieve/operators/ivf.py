"""An optional inverted-file index over vectors: a coarse quantiser whose cells become partitions of a table.

The quantiser is fitted on a bounded sample, the rows with the smallest hashes of their id; every row is indexed. A
search reads only the ``probes`` cells nearest the query, as a pruned partition scan. Exact search is the default
elsewhere; tests measure this index's recall against it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


class IvfIndex:
    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, df: DataFrame, cells: int, id_col: str = "id", vector_col: str = "embedding", sample: int = 20000, rounds: int = 10) -> IvfIndex:
        rows = df.filter(F.col(vector_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), V.doubles(F.col(vector_col)).alias("v"))
        x = _unit(np.array([r["v"] for r in rows.orderBy("h").limit(sample).collect()]))
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(rounds):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            kept = np.bincount(near, minlength=len(centres)) > 0
            centres = _unit(np.where(kept[:, None], sums, centres))
        return cls(centres)

    def cell(self, vector: Column) -> Column:
        """The nearest centre's number, null for a null vector."""
        centres = self.centres

        @F.pandas_udf("int")
        def near(vs):  # noqa: ANN001, ANN202
            import pandas as pd

            out = pd.Series([None] * len(vs), dtype="Int32")
            ok = vs.notna().to_numpy()
            if ok.any():
                out[ok] = np.argmax(np.stack(vs[ok].to_numpy()) @ centres.T, axis=1)
            return out

        return near(V.doubles(vector))

    def write(self, df: DataFrame, path: str, vector_col: str = "embedding") -> None:
        """Every row, partitioned by cell; rows are dealt by cell and a salt so that a large cell is several files."""
        with_cell = df.withColumn("cell", self.cell(F.col(vector_col)))
        with_cell.repartition("cell", F.pmod(F.hash(vector_col), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)

    def search(self, indexed: DataFrame, query: Sequence[float], k: int = 5, probes: int = 8, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
        q = np.asarray(query, float)
        near = np.argsort(-(self.centres @ (q / np.linalg.norm(q))))[:probes].tolist()
        sim = V.cosine(V.doubles(F.col(vector_col)), V.literal(query))
        rows = indexed.filter(F.col("cell").isin(near)).select(id_col, sim.alias("similarity"))
        return rows.orderBy(F.desc("similarity"), id_col).limit(k)
