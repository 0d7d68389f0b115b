"""Services behind an injectable client: embeddings, chat completions, and a paged catalog.

A client is any picklable object; none of them is called on the driver, and none is needed to plan a query.
"""

from __future__ import annotations

import base64
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class EmbeddingClient(Protocol):
    def embed(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        """Index and vector of each text, in any order."""


def budgeted(texts: Sequence[str], most_rows: int, most_chars: int) -> Iterator[slice]:
    """Slices of at most so many rows and, but for a single row, so many characters."""
    at = chars = 0
    for i, x in enumerate(texts):
        if i > at and (i - at >= most_rows or chars + len(x) > most_chars):
            yield slice(at, i)
            at, chars = i, 0
        chars += len(x)
    if at < len(texts):
        yield slice(at, len(texts))


def embedded(rows: DataFrame, client: EmbeddingClient, id_col: str, text_col: str, dimensions: int, most_rows: int = 64, most_chars: int = 100_000, normalize: bool = True) -> DataFrame:
    """``id_col, embedding``: answers in the order of their index, with checked size and finite numbers, at unit length."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = part["text"].fillna("").tolist()
            for s in budgeted(texts, most_rows, most_chars):
                answers = sorted(client.embed(texts[s]))
                if [i for i, _ in answers] != list(range(s.stop - s.start)):
                    raise ValueError("the service left out or repeated an index")
                v = np.array([x for _, x in answers], dtype=np.float64)
                if v.shape != (s.stop - s.start, dimensions) or not np.isfinite(v).all():
                    raise ValueError("the service gave vectors of another size or numbers that aren't finite")
                if normalize:
                    length = np.linalg.norm(v, axis=1, keepdims=True)
                    if (length == 0).any():
                        raise ValueError("the service gave a zero vector")
                    v = v / length
                yield pd.DataFrame({"id": part["id"].iloc[s], "embedding": v.tolist()})

    kind = rows.schema[id_col].dataType.simpleString()
    narrow = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def completed(rows: DataFrame, call: Callable[[str], str], id_col: str, prompt_col: str, tries: int = 3, pause: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Answers ``id_col, answer`` and errors ``id_col, error`` of a call for each prompt, retried with a growing pause."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, prompt in zip(part["id"], part["prompt"], strict=True):
                answer = error = None
                for k in range(tries):
                    try:
                        answer, error = call(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  a failed call is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**k)
                out.append((i, answer, error))
            yield pd.DataFrame(out, columns=["id", "answer", "error"])

    from routeloom.storage import materialize

    kind = rows.schema[id_col].dataType.simpleString()
    narrow = rows.select(F.col(id_col).alias("id"), F.col(prompt_col).alias("prompt"))
    done = materialize(narrow.mapInPandas(run, f"id {kind}, answer string, error string").withColumnRenamed("id", id_col), "answers")
    return done.filter("error is null").drop("error"), done.filter("error is not null").drop("answer")


class PagedCatalog(DataSource):
    """A paged catalog as a data source: ``fetch(page)`` gives rows, and [] after the last page.

    The readers run in processes of their own, so the function travels pickled in the options; ``pages`` bounds the
    pages, which are read in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "skill_id string, name string, downloads long, stars long"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options["fetch"], int(self.options.get("pages", "1")))


class _PageReader(DataSourceReader):
    def __init__(self, fetch: str, pages: int) -> None:
        self.fetch, self.pages = fetch, pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from cloudpickle.loads(base64.b64decode(self.fetch))(partition.value)


def paged_catalog(spark: SparkSession, fetch: Callable[[int], list[tuple]], pages: int) -> DataFrame:
    spark.dataSource.register(PagedCatalog)
    packed = base64.b64encode(cloudpickle.dumps(fetch)).decode()
    return spark.read.format("paged_catalog").option("fetch", packed).option("pages", str(pages)).load()
