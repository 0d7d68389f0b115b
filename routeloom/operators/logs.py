"""Training-log analysis: phases and progress carried forward, repeats suppressed, points thinned and summarized.

A log is ``(run, line_no, line)``. Every window is partitioned by run, so runs are independent; a single run is one
sequence and is processed in order, as its state demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
#: Phase id, shown name and the patterns that announce it; fixed values.
PHASES = (
    ("tokenizer", "02 Tokenizer", (r"(?i)\[0?2\]", r"(?i)[\"']event[\"']\s*:\s*[\"']stage1_progress[\"']")),
    ("memorization", "05 Memorization", (r"(?i)\[0?5\]", r"(?i)\[memorization\]\s+training\s+mixture")),
    ("alignment", "06a Alignment", (r"(?i)\[06a\]",)),
    ("retrieval", "06b Retrieval", (r"(?i)\[06b\]",)),
)
_FIELDS = ("loss", "eval_loss", "epoch", "learning_rate", "grad_norm")


def without_ansi(line: Column) -> Column:
    return F.regexp_replace(line, r"\x1b\[[0-?]*[ -/]*[@-~]", "")


def phase_of(line: Column) -> Column:
    """Id of the phase that a line announces; null for other lines."""
    out = F.lit(None).cast("string")
    for name, _, patterns in reversed(PHASES):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | line.rlike(p)
        out = F.when(hit, name).otherwise(out)
    return out


def progress_of(line: Column) -> Column:
    """Struct of done and total of the last ``a/b`` in a line, thousands separators allowed; null without one."""
    found = F.element_at(F.regexp_extract_all(line, F.lit(r"(?<![\d.])(\d[\d,]*\s*/\s*\d[\d,]*)(?![\d.])")), -1)
    part = lambda i: F.replace(F.trim(F.split(found, "/")[i]), F.lit(","), F.lit("")).try_cast("bigint")
    some = F.size(F.regexp_extract_all(line, F.lit(r"(?<![\d.])(\d[\d,]*\s*/\s*\d[\d,]*)(?![\d.])"))) > 0
    return F.when(some, F.struct(part(0).alias("done"), part(1).alias("total")))


def metric_of(line: Column, key: str) -> Column:
    """Number of a quoted key in a flat mapping; null without one, or if it isn't finite."""
    value = F.regexp_extract(line, rf"[\"']{key}[\"']\s*:\s*({_NUMBER})", 1).try_cast("double")
    return F.when(F.abs(value) != float("inf"), value)


def split_lines(text: DataFrame) -> DataFrame:
    """``run, line_no, line`` from ``run, seq, text``: lines also end at a carriage return, as progress bars use."""
    parts = text.select("run", "seq", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("p", "line")).filter("line <> ''")
    return parts.select("run", F.row_number().over(Window.partitionBy("run").orderBy("seq", "p")).alias("line_no"), "line")


def metric_points(log: DataFrame) -> DataFrame:
    """``run, sequence, phase, kind, loss, epoch, learning_rate, grad_norm, step, total_steps`` of the metric lines.

    Phase and progress are those of the latest line before or at the point; progress is forgotten when the phase
    changes. A point equal to the point before it in all but its number is dropped.
    """
    line = without_ansi(F.col("line"))
    w = Window.partitionBy("run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.withColumn("line", line).withColumn("own_phase", phase_of(F.col("line"))).withColumn("progress", progress_of(F.col("line")))
    rows = rows.withColumn("phase", F.coalesce(F.last("own_phase", True).over(w), F.lit("unknown")))
    whole = Window.partitionBy("run").orderBy("line_no")
    changed = (F.col("phase") != F.coalesce(F.lag("phase").over(whole), F.lit(""))).cast("int")
    rows = rows.withColumn("changed", changed).withColumn("era", F.sum("changed").over(w))
    in_era = Window.partitionBy("run", "era").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("progress", F.last("progress", True).over(in_era))
    rows = rows.withColumns({f: metric_of(F.col("line"), f) for f in _FIELDS})
    points = rows.filter("loss is not null or eval_loss is not null").select(
        "run", "line_no", "phase", F.when(F.col("eval_loss").isNotNull(), "eval").otherwise("train").alias("kind"), F.coalesce("eval_loss", "loss").alias("loss"),
        "epoch", "learning_rate", "grad_norm", F.col("progress.done").alias("step"), F.col("progress.total").alias("total_steps"),
    )
    return without_repeats(points, ["run"], ["line_no"], ["phase", "kind", "loss", "epoch", "learning_rate", "grad_norm", "step"])


def without_repeats(rows: DataFrame, by: list[str], order: list[str], signature: list[str]) -> DataFrame:
    """Rows that differ from the one before in their signature, numbered from 1 as ``sequence``; null equals null."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("__s", F.struct(*signature)).withColumn("__b", F.lag("__s").over(w)).withColumn("__n", F.row_number().over(w))
    kept = marked.filter((F.col("__n") == 1) | ~F.col("__s").eqNullSafe(F.col("__b")))
    return kept.withColumn("sequence", F.row_number().over(w)).drop("__s", "__b", "__n")


def thinned(points: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` points of each group at even places, first and last among them; the last alone for one."""
    if most < 1:
        return points.limit(0)
    w = Window.partitionBy(*by)
    rows = points.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    if most == 1:
        return rows.filter("__i = __n - 1").drop("__i", "__n")
    scale = (F.col("__n") - 1) / F.lit(float(most - 1))
    near = F.floor(F.col("__i") / scale).cast("int")  # only places near the row's own share can be it
    hit = F.exists(F.array(near - 1, near, near + 1), lambda k: (k >= 0) & (k < most) & (F.bround(k * scale).cast("long") == F.col("__i")))
    return rows.filter((F.col("__n") <= most) | hit).drop("__i", "__n")


def loss_summary(points: DataFrame) -> DataFrame:
    """Per run, phase and kind: number of points, the latest and the least loss and where they are."""
    return points.groupBy("run", "phase", "kind").agg(
        F.count(F.lit(1)).alias("points"), F.max_by("loss", "sequence").alias("latest"), F.min(F.struct("loss", "sequence")).alias("b")
    ).select("run", "phase", "kind", "points", "latest", F.col("b.loss").alias("best"), F.col("b.sequence").alias("best_sequence"))


def log_tail(log: DataFrame, lines: int, width: int) -> DataFrame:
    """The last lines of each run, each cut to its last ``width`` characters."""
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("line_no")))
    return log.withColumn("__n", rank).filter(F.col("__n") <= lines).select("run", "line_no", F.expr(f"right(line, {width})").alias("line"))


def progress_scan(log: DataFrame) -> DataFrame:
    """Per run the latest phase, checkpoint path, progress and out-of-memory line, each null if there is none."""
    line = F.col("line")
    at = lambda value, cond: F.max_by(F.when(cond, value), F.when(cond, F.col("line_no")))
    rows = log.withColumn("phase", phase_of(line)).withColumn("progress", progress_of(line))
    path = F.regexp_extract(line, r"(\S*checkpoint-\d+)", 1)
    return rows.groupBy("run").agg(
        at(F.col("phase"), F.col("phase").isNotNull()).alias("phase"),
        at(path, path != "").alias("checkpoint"),
        at(F.col("progress"), F.col("progress").isNotNull()).alias("progress"),
        at(line, line.rlike("(?i)out of memory")).alias("oom"),
    )


def run_status(runs: DataFrame, live: DataFrame) -> DataFrame:
    """``status`` of runs ``(run, pid, status)``: running without a live process is unknown."""
    alive = live.select("pid", F.lit(True).alias("__alive")).dropDuplicates(["pid"])
    joined = runs.join(alive, "pid", "left")
    lost = (F.col("status") == "running") & F.col("__alive").isNull()
    return joined.withColumn("status", F.when(lost, "unknown").otherwise(F.col("status"))).drop("__alive")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key, schema version and content hash were not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def folded(operations: DataFrame, key: str, revision: str) -> DataFrame:
    """The current rows of an append-only log of ``add`` and ``remove``: the last operation of each key decides."""
    rest = [c for c in operations.columns if c not in (key, revision)]
    last = operations.groupBy(key).agg(F.max(F.struct(revision, *rest)).alias("o"))
    return last.filter("o.op = 'add'").select(key, f"o.{revision}", *(f"o.{c}" for c in rest if c != "op"))


def gpu_metrics(gpus: DataFrame, processes: DataFrame) -> DataFrame:
    """GPUs of CSV lines with their processes: ``index, uuid, name, used_mb, total_mb, processes``.

    ``gpus(line)``: index, uuid, name, used, total; ``processes(line)``: uuid, pid, used. Malformed lines are dropped,
    and so are processes of unknown GPUs.
    """
    part = lambda i: F.trim(F.split("line", ",")[i])
    g = gpus.filter(F.size(F.split("line", ",")) == 5).select(
        part(0).try_cast("int").alias("index"), part(1).alias("uuid"), part(2).alias("name"), part(3).try_cast("double").alias("used_mb"), part(4).try_cast("double").alias("total_mb")
    )
    p = processes.filter(F.size(F.split("line", ",")) == 3).select(part(0).alias("uuid"), F.struct(part(1).try_cast("int").alias("pid"), part(2).try_cast("double").alias("used_mb")).alias("p"))
    lists = p.filter("p.pid is not null").groupBy("uuid").agg(F.array_sort(F.collect_list("p")).alias("processes"))
    none = F.array().cast(lists.schema["processes"].dataType)
    return g.filter("index is not null and uuid <> ''").join(lists, "uuid", "left").withColumn("processes", F.coalesce("processes", none))
