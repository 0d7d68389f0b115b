"""NumPy matrices and edge lists as tables with explicit row numbers, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """``path, row_id, vector`` of ``.npy`` files; a file is one task's work."""
    import io

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)
                if m.ndim != 2:
                    raise ValueError(f"{p} is not a matrix")
                for i in range(0, len(m), 10_000):
                    block = m[i : i + 10_000]
                    yield pd.DataFrame({"path": p, "row_id": np.arange(i, i + len(block)), "vector": block.astype(np.float64).tolist()})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row_id long, vector array<double>")


def bound_ids(matrix: DataFrame, ids: DataFrame, digest: str) -> DataFrame:
    """Rows with the ids at their places ``(row_id, id)``, after the digest of the ids in order was checked.

    The ids of a catalog are gathered for the digest; that is what binding a matrix to a catalog means.
    """
    from routeloom.functions.hashing import ordered_ids_digest

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "id"))), lambda x: x["id"].cast("string"))
    if ids.agg(ordered_ids_digest(ordered)).first()[0] != digest:
        raise ValueError("the matrix belongs to other ids")
    return matrix.join(ids, "row_id")
