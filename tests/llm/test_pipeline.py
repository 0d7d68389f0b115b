"""The pipeline against a plain version of its stages, and its contract."""

import hashlib

import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from routeloom.llm import op02_toxicity, op03_byte_bpe, registry
from tests.compare import DATA
from tests.llm.test_corpus_operators import _classes


def test_every_query_is_registered():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}, name


def test_pipeline_equals_plain_stages(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    model = op02_toxicity.train(documents.filter(~registry.held_out()), spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = dict(zip(rows, op02_toxicity.score_texts(model, [r.text for r in rows.values()]), strict=True))
    left = {k: r for k, r in rows.items() if scores[k][0] < 0.7}
    # lines on more than a tenth, and at least four, of a source's documents
    pages, total = {}, {}
    for r in left.values():
        total[r.source] = total.get(r.source, 0) + 1
        for line in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            pages[r.source, line] = pages.get((r.source, line), 0) + 1
    bad = {k for k, n in pages.items() if n >= 4 and n > total[k[0]] * 0.1}
    texts = {k: "\n".join(x for x in (r.text or "").split("\n") if (r.source, x.strip(" ")) not in bad) for k, r in left.items()}
    texts = {k: texts[k] for k, (n, c) in _classes(texts, 80).items() if k == c or not n}
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {k: t for k, t in texts.items() if not any(i in t for i in items)}
    path, pattern = registry.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op03_byte_bpe.load_ranks(path), special_tokens={})
    want = {}
    for k, t in clean.items():
        ids = enc.encode_ordinary(t)
        want[k] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert found == want


def test_line_stage_updates_the_length(spark):
    frame = spark.createDataFrame([(i, f"menu\nbody {i}", "a", "en", 99) for i in range(20)], "doc_id long, text string, source string, lang string, n_chars long")
    found = corpus_pipeline.line_dedup(spark, frame, DATA)
    assert found.filter(F.col("n_chars") != F.length("text")).count() == 0


def _tables(spark, folder, documents, labels, benchmark):
    extra = "n_dropped string, site string, overlap int, component_id long"  # clash with what operators make
    rows = [(*d, f"own {i}", "s", i, 7) for i, d in enumerate(documents)]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_of_odd_rows(spark, tmp_path):
    passage = "this benchmark passage of a dozen and more words must not be learned by heart at all"
    documents = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (None, "no id here at all", "en", "a", 17), (3, " \n ", "en", "a", 3),
        (4, "word " * 60_000, "en", "b", 300_000), (5, f"before it {passage} after it", "en", "b", 99),
        (6, "twice the same words stand here in a row", "en", "c", 40), (6, "twice the same words stand here in a row", "en", "c", 40),
        (7, "twice the same words stand here in a row", "en", "c", 40), (8, None, None, None, None),
    ]
    labels = [(1, None, None), (None, 1, 1), (4, 1, 0)]
    where = _tables(spark, tmp_path, documents, labels, [(1, passage), (2, None), (None, "")])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns, name
        assert stage(spark, docs.limit(0), where).count() == 0, name
    lines = corpus_pipeline.line_dedup(spark, docs, where)
    assert {r.n_dropped for r in lines.collect()} == {f"own {i}" for i in range(len(documents))}
    found = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, where).collect()]
    assert sorted(str(k) for k, _ in found) == sorted(map(str, [1, 2, None, 3, 4, 6, 6, 8]))
    assert all(n == 0 for k, n in found if k in (1, 2, 8)) and {n for k, n in found if k == 4} != {0}


def test_pipeline_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, _tables(spark, tmp_path, [], [], [])).count() == 0
