"""The corpus pipeline: stages over ``documents``, each on all that its predecessor kept.

Toxic documents go; boilerplate lines go from the texts; one document of each group of near copies stays; documents
with benchmark text go; what is left is encoded, and decoded again as a check. Every stage but the last returns the
columns of ``documents``, with ``n_chars`` as it is after the change.

Defined cases, for all stages: rows with a null text, id, language or source stay unless a stage rejects their text,
which it can't of a null one; an empty table gives an empty table, as do empty ``labels`` or ``benchmark`` reject
nothing; texts of any length are judged whole; rows that repeat an id are rows each; columns beyond those of
``documents`` pass through all stages but the last, also if they are named like a column that an operator makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import op02_toxicity, op03_byte_bpe, op05_decontamination, op07_line_dedup, op10_near_dedup, registry
from routeloom.storage import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more; learns from the labelled rows that are not held out.

    A null or blank text scores as a clean one.
    """
    model = op02_toxicity.train(docs.filter(~registry.held_out()), registry.table(spark, sf_dir, "labels"))
    return op02_toxicity.reject_toxic(docs, model, threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the boilerplate lines of each source from its texts; keeps every document.

    Documents without a source are a source of their own. ``n_chars`` changes with the text only.
    """
    own = [c for c in ("n_lines", "n_dropped") if c in docs.columns]  # the operator would take their places
    found = op07_line_dedup.line_dedup(docs.withColumnsRenamed({c: f"__own_{c}" for c in own}))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    kept = lambda c: F.col(f"__own_{c}").alias(c) if c in own else F.col(f"`{c}`")
    return found.select(*(n_chars if c == "n_chars" else kept(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near copies: five-word shingles, similarity 0.8.

    Rows without words, or without an id, stay; so do rows that repeat an id, or go if each is a copy.
    """
    return op10_near_dedup.near_dedup(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark; of rows that repeat an id all go if one has."""
    return op05_decontamination.decontaminate(docs, registry.table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as digests of the ids and of the bytes that they decode to; a null text has none."""
    path, pattern = registry.vocabulary()
    coded = op03_byte_bpe.bpe_encode(docs, path, pattern, decoded=True, remembered=150_000)
    return coded.select("doc_id", *registry.bpe_digests())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]
#: SQL has neither the learned field nor the tokenizer; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
