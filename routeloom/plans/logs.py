"""Plans of log analysis: a run is a user, a line an event, the phase its type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.operators import logs as l
from routeloom.plans.registry import plan, table

_LOG_SQL = """log AS (SELECT user_id % 7 AS run, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS line_no, event_type, round(value, 2) AS value FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy((F.col("user_id") % 7)).orderBy("ts", "event_id")
    return events.select((F.col("user_id") % 7).alias("run"), F.row_number().over(w).alias("line_no"), "event_type", F.round("value", 2).alias("value"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines: signup and error announce phases, views carry progress, others metrics."""
    text = (
        F.when(F.col("event_type") == "signup", "\x1b[1m[05]\x1b[0m start")
        .when(F.col("event_type") == "error", "[06b] retrieval")
        .when(F.col("event_type") == "view", F.format_string("step %d/1,000", F.col("line_no") % 1000))
        .when(F.col("event_type") == "click", F.concat(F.lit("{'loss': "), (F.floor("value") / 10).cast("string"), F.lit(", 'epoch': 1.5}")))
        .otherwise(F.concat(F.lit("{'eval_loss': "), (F.floor("value") / 10).cast("string"), F.lit("}")))
    )
    return _log(spark, sf_dir).select("run", "line_no", text.alias("line"))


_POINTS_SQL = f"""{_LOG_SQL},
c AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'memorization' WHEN event_type = 'error' THEN 'retrieval' END IGNORE NULLS) OVER w, 'unknown') AS phase,
      CASE WHEN event_type = 'view' THEN line_no % 1000 END AS p FROM log WINDOW w AS (PARTITION BY run ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, CASE WHEN phase IS DISTINCT FROM lag(phase) OVER (PARTITION BY run ORDER BY line_no) THEN 1 ELSE 0 END AS ch FROM c),
s AS (SELECT *, sum(ch) OVER (PARTITION BY run ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS era FROM e),
q AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY run, era ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS step FROM s),
pt AS (SELECT run, line_no, phase, CASE WHEN event_type = 'purchase' THEN 'eval' ELSE 'train' END AS kind, (floor(value) / 10)::DOUBLE AS loss, step FROM q WHERE event_type IN ('click', 'purchase')),
d AS (SELECT *, (phase, kind, loss, step) IS DISTINCT FROM lag((phase, kind, loss, step)) OVER w AS new, row_number() OVER w AS n FROM pt WINDOW w AS (PARTITION BY run ORDER BY line_no)),
points AS (SELECT run, line_no, phase, kind, loss, step, row_number() OVER (PARTITION BY run ORDER BY line_no) AS sequence FROM d WHERE n = 1 OR new)"""


@plan("metric_points", f"WITH {_POINTS_SQL} SELECT run, line_no::INTEGER AS line_no, phase, kind, loss, step::BIGINT AS step, sequence::INTEGER AS sequence FROM points")
def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.metric_points(_lines(spark, sf_dir)).select("run", "line_no", "phase", "kind", "loss", "step", "sequence")


@plan(
    "loss_summary",
    f"""WITH {_POINTS_SQL} SELECT run, phase, kind, count(*) AS points, max_by(loss, sequence) AS latest, min(loss) AS best,
    min(struct_pack(a := loss, b := sequence)).b::INTEGER AS best_sequence FROM points GROUP BY run, phase, kind""",
)
def loss_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.loss_summary(l.metric_points(_lines(spark, sf_dir)))


@plan(
    "thinned_points",
    f"""WITH {_POINTS_SQL}, n AS (SELECT *, sequence - 1 AS i, count(*) OVER (PARTITION BY run) AS n FROM points),
    k AS (SELECT DISTINCT run, least(n - 1, round_even(g * ((n - 1) / 19.0::DOUBLE), 0))::BIGINT AS i FROM (SELECT DISTINCT run, n FROM n), (SELECT unnest(range(0, 20)) AS g))
    SELECT run, sequence::INTEGER AS sequence, loss FROM n WHERE n <= 20 OR EXISTS (SELECT 1 FROM k WHERE k.run = n.run AND k.i = n.i)""",
)
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.thinned(l.metric_points(_lines(spark, sf_dir)), ["run"], ["sequence"], 20).select("run", "sequence", "loss")


@plan("log_tail", f"WITH {_LOG_SQL} SELECT run, line_no::INTEGER AS line_no, right(event_type, 4) AS line FROM log QUALIFY row_number() OVER (PARTITION BY run ORDER BY line_no DESC) <= 12")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.log_tail(_log(spark, sf_dir).withColumnRenamed("event_type", "line"), 12, 4)


@plan(
    "changed_types",
    f"""WITH {_LOG_SQL}, d AS (SELECT *, lag(event_type) OVER (PARTITION BY run ORDER BY line_no) AS b FROM log)
    SELECT run, line_no::INTEGER AS line_no, event_type, row_number() OVER (PARTITION BY run ORDER BY line_no)::INTEGER AS sequence FROM d WHERE b IS DISTINCT FROM event_type""",
)
def changed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.without_repeats(_log(spark, sf_dir).drop("value"), ["run"], ["line_no"], ["event_type"]).select("run", "line_no", "event_type", "sequence")


@plan(
    "progress_scan",
    f"""WITH {_LOG_SQL} SELECT run, max_by(CASE WHEN event_type = 'signup' THEN 'memorization' ELSE 'retrieval' END, line_no) FILTER (event_type IN ('signup', 'error')) AS phase,
    max_by((line_no % 1000)::BIGINT, line_no) FILTER (event_type = 'view') AS done FROM log GROUP BY run""",
)
def progress_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).withColumn("line", l.without_ansi(F.col("line")))
    return l.progress_scan(lines).select("run", "phase", F.col("progress.done").alias("done"))


@plan(
    "pending_work",
    "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus)",
)
def pending_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("o_orderstatus"))
    return l.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey", "o_orderstatus"])


@plan(
    "folded_overlay",
    """WITH o AS (SELECT user_id, event_id AS revision, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS op, value FROM events)
    SELECT user_id, revision, value FROM o QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) = 1 AND op = 'add'""",
)
def folded_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("revision"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("op"), "value")
    return l.folded(ops, "user_id", "revision")


@plan(
    "run_status",
    "SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 1 THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders",
)
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("pid"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    live = runs.select("pid").distinct().filter("pid % 2 = 0")
    return l.run_status(runs, live).select("run", "status")


@plan(
    "hourly_events",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from routeloom.streaming.windows import hourly_totals

    found = hourly_totals(table(spark, sf_dir, "events"), watermark=None)
    kind = table(spark, sf_dir, "events").schema["ts"].dataType
    return found.select(F.col("hour").cast(kind).alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))
