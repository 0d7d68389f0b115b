"""Language identification by compression with one raw-content dictionary for each language.

A text is encoded by zstandard with the dictionary of every language in turn; the language whose dictionary
gives the smallest frame is the prediction (letter case, ASCII punctuation and digits are folded away first). A
narrow margin between the two smallest frames marks the prediction as rejected.

The dictionaries are the whole model. They are filled from a bounded sample: of each language the ``sample_docs``
labelled texts that come first by a hash of their id, up to ``per_doc`` characters of each, at most ``dict_bytes``
bytes together. At most ``max_languages`` languages are learned, the most frequent first.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any labelled text
everything is ``und``; ties go to the language with more labelled texts, then by name; rows with a null language
teach nothing; texts of any length are compressed whole; an empty table gives an empty result; repeated rows are predicted each for itself; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeloom.llm.workers import tidy

UNDETERMINED = "und"
#: ASCII punctuation and digits say nothing about the language.
_DROPPED = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def normalized(text: str) -> bytes:
    """What is compressed: the text in lower case without ASCII punctuation and digits."""
    return text.lower().encode().translate(None, _DROPPED)


def train_dictionaries(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 200,
    per_doc: int = 1200,
    dict_bytes: int = 112_640,
    max_languages: int = 256,
) -> dict[str, bytes]:
    """Raw dictionary content by language, most frequent language first.

    The ranking window keeps ``sample_docs`` ids of each language in every map task before the shuffle, so a language
    that holds most rows moves no more than the others. Only the sample, bounded by the parameters, is collected.
    """
    ids = labelled.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = ids.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    langs = ids.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    part = ids.select("lang", "doc_id", F.substring("text", 1, per_doc).alias("text"))
    rows = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_docs).collect()
    by_lang: dict[str, list] = {r["lang"]: [] for r in langs}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        if r["lang"] in by_lang:
            by_lang[r["lang"]].append(r["text"])
    # zstandard reaches recent content by shorter offsets, so what was sampled first comes last
    return {k: b"\n".join(normalized(t) for t in reversed(v))[-dict_bytes:] for k, v in by_lang.items()}


class CompressionClassifier:
    """Smallest-frame classifier over fixed dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 5) -> None:
        self.langs = list(dictionaries)
        self.letter = regex.compile(r"\p{L}").search
        self.compressors = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compressors.append(
                zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def predict(self, text: str | None, margin: float) -> tuple[str, float, float, bool]:
        """Language, score from 0 to 1, relative margin of the two smallest frames, and whether it is rejected."""
        if not text or not self.langs or not self.letter(text):
            return UNDETERMINED, 0.0, 0.0, True
        raw = normalized(text)
        sizes = [len(c.compress(raw)) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[best], 1.0, 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        gap = (second - sizes[best]) / second
        # bytes saved are log-likelihood: the share of the best among all, by bytes of a thousand at most, so that what a
        # long text gives is its rate and not its length
        per = 0.7 * min(1.0, 1000 / max(1, len(raw)))
        total = sum(math.exp(-(s - sizes[best]) * per) for s in sizes)
        return self.langs[best], 1.0 / total, gap, gap < margin


def language_id(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    margin: float = 0.02,
    level: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected`` for every whole text. One narrow pass; nothing is shuffled."""
    out = pa.schema(
        [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(dictionaries, level)
        for batch in batches:
            found = [model.predict(t.as_py(), margin) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], out.field(i + 1).type) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, margin double, rejected boolean")
