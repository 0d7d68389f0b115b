"""Queries that apply each operator to its whole table, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import op01_language_id as op1
from routeloom.llm import op02_toxicity as op2
from routeloom.llm import op03_byte_bpe as op3
from routeloom.llm import op04_fingerprints as op4
from routeloom.llm import op05_decontamination as op5
from routeloom.llm import op06_url_filters as op6
from routeloom.llm import op07_line_dedup as op7
from routeloom.llm import op08_suffix_dedup as op8
from routeloom.llm import op09_token_counts as op9
from routeloom.llm import op10_near_dedup as op10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Path of the byte-level vocabulary and its pre-token pattern, from the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def held_out():
    """Rows that no classifier learns from; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op1.train_dictionaries(docs.filter(~held_out()))
    found = op1.language_id(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def train_toxicity(spark: SparkSession, sf_dir: str) -> op2.Field:
    """The field learned from the labelled rows that are not held out."""
    return op2.train(table(spark, sf_dir, "documents").filter(~held_out()), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = op2.toxicity(docs, train_toxicity(spark, sf_dir), threshold=0.7)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


def bpe_digests() -> list:
    """Digest columns of ``ids`` and ``decoded``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    coded = op3.bpe_encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True)
    return coded.select("doc_id", *bpe_digests())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4.edited_likeness(table(spark, sf_dir, "documents"))
    digest = F.sha2("edited_text", 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op5.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def _sql_seed(mask: str) -> str:
    return " || ' ' || ".join(f"ws[pos + {k + 1}]" for k, bit in enumerate(mask) if bit == "1")


_UNSPACED = "([" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", op5.UNSPACED) + "])"
_SPLIT = rf"list_filter(regexp_split_to_array(regexp_replace(lower(text), '{_UNSPACED}', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
# Items of a window or more by seeds; shorter ones by comparing them at every place.
OP5_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_SPLIT} AS ws FROM documents),
i AS (SELECT item_id AS id, {_SPLIT} AS ws FROM benchmark),
dp AS (SELECT id, unnest(range(0, len(ws) - 7)) AS pos, ws FROM d WHERE len(ws) >= 8),
ip AS (SELECT id, unnest(range(0, len(ws) - 7)) AS pos, ws FROM i WHERE len(ws) >= 13),
ds AS ({" UNION ALL ".join(f"SELECT id, pos, {m} AS m, {_sql_seed(x)} AS s FROM dp" for m, x in enumerate(op5.MASKS))}),
js AS ({" UNION ALL ".join(f"SELECT id, pos, {m} AS m, {_sql_seed(x)} AS s FROM ip" for m, x in enumerate(op5.MASKS))}),
h AS (SELECT DISTINCT ds.id AS doc_id, ds.pos AS pos, js.id AS item_id, js.pos AS ipos FROM ds JOIN js ON ds.m = js.m AND ds.s = js.s),
v AS (SELECT doc_id, item_id, list_transform(range(greatest(0, ipos - 5), least(len(i.ws), ipos + 13)),
        lambda k: CASE WHEN pos - ipos + k >= 0 AND d.ws[pos - ipos + k + 1] = i.ws[k + 1] THEN 1 ELSE 0 END) AS f
      FROM h JOIN d ON d.id = doc_id JOIN i ON i.id = item_id),
o AS (SELECT doc_id, item_id, list_max(list_transform(range(1, greatest(1, len(f) - 12) + 1), lambda a: list_sum(f[a:a + 12]))) AS best, 11 AS need FROM v
      UNION ALL SELECT d.id, i.id, list_max(list_transform(range(0, len(d.ws) - len(i.ws) + 1), lambda p: list_sum(list_transform(range(1, len(i.ws) + 1), lambda k: CASE WHEN d.ws[p + k] = i.ws[k] THEN 1 ELSE 0 END)))),
        CASE WHEN len(i.ws) < 8 THEN len(i.ws) ELSE ceil(len(i.ws) * 0.8::DOUBLE) END FROM d JOIN i ON len(i.ws) BETWEEN 1 AND 12 AND len(d.ws) >= len(i.ws)),
p AS (SELECT doc_id, item_id, max(best) AS overlap FROM o WHERE best >= need GROUP BY doc_id, item_id)
SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(overlap)::INTEGER AS overlap FROM p GROUP BY doc_id
"""


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return op7.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT source, line, count(*) AS pages
      FROM (SELECT source, unnest(list_distinct(list_transform(ls, lambda s: trim(s)))) AS line FROM d)
      WHERE line <> '' GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT c.source, list(line) AS boiler
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE pages >= 4 AND pages > total * 0.1::DOUBLE GROUP BY c.source),
k AS (SELECT doc_id, text, ls,
             list_filter(ls, lambda s: trim(s) = '' OR b.boiler IS NULL OR NOT list_contains(b.boiler, trim(s))) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(len(ls) - len(kept), 0)::INTEGER AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op8.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    return op9.token_counts(table(spark, sf_dir, "documents"), path, pattern)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10.similarity_classes(table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP10_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r(u, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.u, r.m FROM r JOIN e ON r.u = e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(m) AS component_id FROM r GROUP BY u) c ON c.u = d.doc_id
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_decontamination": op5_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_near_dedup": op10_near_dedup,
}

ORACLES = {"op5_decontamination": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_near_dedup": OP10_SQL}
