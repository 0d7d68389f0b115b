"""Sources and sinks on small files."""

import hashlib
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.sources import archives, jsonl, matrices, services
from routeloom.streaming import metrics, windows


def test_jsonl_rejects_have_their_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n[1]\n{"id": broken\n{"id": "y"}\n')
    rows, bad = jsonl.read_jsonl(spark, str(tmp_path), "id string, n int")
    assert sorted((r.id, r.n, r.line_no) for r in rows.collect()) == [("x", 1, 1), ("y", None, 5)]
    assert sorted((r.line_no, r.reason) for r in bad.collect()) == [(3, "not an object"), (4, "invalid JSON")]
    assert jsonl.count_lines(spark, str(tmp_path)) == 4


def test_write_counts_rows(spark, tmp_path):
    assert jsonl.write_jsonl(spark.range(7), str(tmp_path / "out")) == 7
    assert jsonl.count_lines(spark, str(tmp_path / "out")) == 7


def test_queries_keep_their_line_numbers(spark, tmp_path):
    (tmp_path / "q.txt").write_text("﻿one\n\n  three \n")
    whole, long = jsonl.query_lines(spark, str(tmp_path), longest=4)
    assert [tuple(r) for r in whole.collect()] == [("line-000001", "one")]
    assert [(r.line_no, r.n_chars) for r in long.collect()] == [(3, 5)]


def test_token_list_and_digests(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\na\nc d\n")
    rows, bad = jsonl.token_list(spark, str(tmp_path))
    assert rows.count() == 4 and sorted(r.reason for r in bad.collect()) == ["blank or white space", "repeated", "repeated"]
    files = jsonl.file_digests(spark, str(tmp_path))
    sha = hashlib.sha256(b"a\nb\na\nc d\n").hexdigest()
    manifest = spark.createDataFrame([("t.txt", sha), ("u.txt", sha)], "name string, sha256 string")
    assert [tuple(r) for r in jsonl.checksum_violations(files, manifest).collect()] == [("u.txt", "missing")]


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archives_are_checked_and_read(spark, tmp_path):
    (tmp_path / "good.zip").write_bytes(_zip({"root/SKILL.md": "---\nname: Good\ndescription: d\n---\n# T\nbody *text*", "root/x/README.md": "no"}))
    (tmp_path / "bad.zip").write_bytes(_zip({"../evil": "x"}))
    members = archives.read_archives(spark, str(tmp_path)).cache()
    assert [r.error for r in members.filter("error is not null").collect()] == ["unsafe member '../evil'"]
    good = members.filter("error is null")
    assert sorted(r.member for r in archives.without_wrapper(good).collect()) == ["SKILL.md", "x/README.md"]
    assert archives.subtree(good, "root/x").first().member == "README.md"
    row = archives.catalog_rows(good).first()
    assert (row["name"], row.description, row.text) == ("Good", "d", "T body text")
    members.unpersist()


class Client:
    def embed(self, texts):
        return [(i, [float(len(t)), 1.0]) for i, t in reversed(list(enumerate(texts)))]


def test_embeddings_are_ordered_and_unit(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    found = {r.id: r.embedding for r in services.embedded(rows, Client(), "id", "text", 2).collect()}
    assert found[1] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)]) and found[2] == [0.0, 1.0]
    assert list(services.budgeted(["aa", "b", "cccc", "d"], 2, 4)) == [slice(0, 2), slice(2, 3), slice(3, 4)]


def test_failed_calls_are_rows(spark):
    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    good, bad = services.completed(spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, p string"), call, "id", "p")
    assert [(r.id, r.answer) for r in good.collect()] == [(1, "OK")] and [(r.id, r.error) for r in bad.collect()] == [(2, "ValueError: no")]


def test_matrices_bind_to_ids(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    m = matrices.read_matrices(spark, str(tmp_path))
    ids = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row_id long, id string")
    sha = hashlib.sha256(b"a\nb\nc\n").hexdigest()
    assert {r.id: r.vector for r in matrices.bound_ids(m, ids, sha).collect()}["b"] == [2.0, 3.0]
    with pytest.raises(ValueError, match="other ids"):
        matrices.bound_ids(m, ids, "0")


def test_metric_stream_equals_its_batch_twin(spark, tmp_path):
    from routeloom.operators import logs

    text = "[05] start\n10/100\n{'loss': 2.5}\n{'loss': 2.5}\n[06a] go\n{'eval_loss': 2.1}\n{'loss': 1.5}\n"
    for i in range(0, len(text), 17):
        spark.createDataFrame([("r", i, text[i : i + 17])], "run string, seq long, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq long, text string").option("maxFilesPerTrigger", 100).json(str(tmp_path / "in"))
    query = metrics.metric_stream(stream).writeStream.foreachBatch(metrics.once_per_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.phase, r.kind, r.loss, r.step) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("sequence").collect()]
    lines = logs.split_lines(spark.createDataFrame([("r", 0, text)], "run string, seq long, text string"))
    want = [(r.phase, r.kind, r.loss, r.step) for r in logs.metric_points(lines).orderBy("sequence").collect()]
    assert got == want and len(got) == 3


def test_sessions(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 02:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in windows.sessions(events).collect()) == [1, 2]


def test_paged_catalog(spark):
    pages = {0: [("a", "A", 3, 1)], 1: [("b", "B", 2, 2)]}
    found = services.paged_catalog(spark, lambda p: pages.get(p, []), 3)
    assert sorted(r.skill_id for r in found.collect()) == ["a", "b"]
