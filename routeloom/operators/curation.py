"""Curation of catalogs and queries: normal forms, lookups, attempts and runs, backfill needs, patches and lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routeloom.functions import text as t
from routeloom.operators.validation import duplicates, violation

#: Fields of the hierarchy of a skill; fixed values.
HIERARCHY = ("major", "sub", "domain", "primary_action", "primary_object")
#: Phrases by which a query speaks of the data set and not of a need; fixed values.
ROUTING_PHRASES = ("调用工具", "使用skill", "目标候选", "路由训练")


def _or_null(rows: DataFrame, column: str) -> Column:
    return F.col(column) if column in rows.columns else F.lit(None).cast("string")


def normalized_skills(rows: DataFrame, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``skill_id, name, description, text, hierarchy, namespace, license, source_url``, and the rows without an id.

    Absent columns count as null; the parts of the hierarchy are a struct that keeps nulls.
    """
    name, description, body = (F.coalesce(_or_null(rows, c).cast("string"), F.lit("")) for c in ("name", "description", "body"))
    skill_id = F.trim(F.coalesce(_or_null(rows, "id").cast("string"), F.lit("")))
    found = rows.withColumn("skill_id", skill_id)
    fields = [_or_null(rows, c).cast("string").alias(c) for c in ("namespace", "license", "source_url")]
    hierarchy = F.struct(*(_or_null(rows, c).cast("string").alias(c) for c in HIERARCHY)).alias("hierarchy")
    text = t.skill_text(name, description, body, max_chars).alias("text")
    good = found.filter("skill_id <> ''").select("skill_id", name.alias("name"), description.alias("description"), text, hierarchy, *fields)
    return good, found.filter("skill_id = ''").drop("skill_id")


def normalized_queries(rows: DataFrame) -> DataFrame:
    """``query_id, query, skill_ids, k`` and, where the rows have them, ``source_query_id`` and ``target_order_variant``.

    The id is ``id``, or ``query_id`` where that is blank; a blank source is null.
    """
    filled = lambda c: F.nullif(_or_null(rows, c).cast("string"), F.lit(""))
    out = rows.select(
        F.coalesce(filled("id"), filled("query_id")).alias("query_id"),
        F.col("query").cast("string").alias("query"),
        F.col("skill_ids").cast("array<string>").alias("skill_ids"),
        F.size("skill_ids").alias("k"),
        filled("source_query_id").alias("source_query_id"),
        _or_null(rows, "target_order_variant").cast("int").alias("target_order_variant"),
    )
    return out.drop(*(c for c in ("source_query_id", "target_order_variant") if c not in rows.columns))


def incremental_query_violations(queries: DataFrame, shortest: int = 2, longest: int = 180) -> DataFrame:
    """Rules of queries ``skill_id, query`` of new skills: length, no query twice for a skill whatever its case, no opaque
    id and no talk of routing; and every skill needs a query."""
    rows = queries.withColumn("plain", t.collapsed(F.col("query"))).withColumn("key", F.lower("plain"))
    opaque = F.col("skill_id").rlike("[@/_]") & F.contains("key", F.lower("skill_id"))
    phrase = reduce(lambda a, b: a | b, (F.col("key").contains(p) for p in ROUTING_PHRASES))
    short = violation(rows.filter(~F.length("plain").between(shortest, longest)), "length", F.col("skill_id"), F.length("plain"))
    leaks = violation(rows.filter(opaque), "identifier leak", F.col("skill_id"))
    talk = violation(rows.filter(phrase), "routing language", F.col("skill_id"))
    return reduce(DataFrame.unionByName, (short, leaks, talk, duplicates(rows, ["skill_id", "key"], "duplicate query")))


def enriched(results: DataFrame, catalog: DataFrame, key: str = "skill_id") -> tuple[DataFrame, DataFrame]:
    """Results with the columns of the catalog, and the results whose key it lacks.

    Columns of both keep the result's value. The planner broadcasts the catalog if its size allows.
    """
    own = catalog.select(key, *(c for c in catalog.columns if c not in results.columns))
    return results.join(own, key), results.join(catalog.select(key), key, "left_anti")


def last_attempts(attempts: DataFrame, owner: str, order: list[str], most: int = 12) -> DataFrame:
    """The last ``most`` rows of each owner, with ``position`` from 1 in ascending order."""
    last = F.row_number().over(Window.partitionBy(owner).orderBy(*(F.desc(c) for c in order)))
    kept = attempts.withColumn("__last", last).filter(F.col("__last") <= most)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(*order))).drop("__last")


def latest_versions(versions: DataFrame, profile: str = "profile_id", version: str = "version") -> DataFrame:
    """The row of the highest version of each profile; of equal ones any."""
    others = [c for c in versions.columns if c not in (profile, version)]
    best = versions.groupBy(profile).agg(F.max_by(F.struct(version, *others), version).alias("v"))
    return best.select(profile, f"v.{version}", *(f"v.{c}" for c in others))


def clamped(limit: int, low: int, high: int) -> int:
    """A limit that a user gives, within bounds; the lower bound wins if they cross."""
    return max(low, min(int(limit), high))


def newest_runs(runs: DataFrame, run: str = "run_id", prefix: str = "run-", limit: int = 20) -> DataFrame:
    """The newest runs, ids in descending order; the limit is clamped to 0 to 200."""
    return runs.filter(F.col(run).startswith(prefix)).orderBy(F.desc(run)).limit(clamped(limit, 0, 200))


def natural_order(text: Column) -> Column:
    """A sort key that puts numbers in a text in numeric order, whatever the case: runs of digits padded to one length."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+|[^0-9]+)"))
    padded = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p))
    return F.array_join(padded, "")


def alignment_needs(profiles: DataFrame, passed: DataFrame, least: int = 1) -> DataFrame:
    """``skill_id, requirement, need``: what a skill lacks of the passed queries that it should have.

    ``profiles(skill_id, routing_mode, n_aliases)``, ``passed(skill_id, requirements)`` a row for each passed query. Of
    any kind a skill needs ``least`` (requirement ``any``); a native follow-up; with aliases an explicit identity; in
    composite mode two bundles, in meta mode two task contexts. A query without requirements counts as ``core``.
    """
    mode = F.coalesce("routing_mode", F.lit(""))
    wanted = F.array_compact(
        F.array(
            F.struct(F.lit("any").alias("requirement"), F.lit(least).alias("least")),
            F.struct(F.lit("native_followup").alias("requirement"), F.lit(1).alias("least")),
            *(
                F.when(cond, F.struct(F.lit(name).alias("requirement"), F.lit(n).alias("least")))
                for cond, name, n in (
                    (F.col("n_aliases") > 0, "identity_explicit", 1),
                    (mode == "composite", "composite_bundle", 2),
                    (mode == "meta", "meta_task_context", 2),
                )
            ),
        )
    )
    minimums = profiles.select("skill_id", F.explode(wanted).alias("w")).select("skill_id", "w.*")
    given = F.when(F.size("requirements") > 0, F.col("requirements")).otherwise(F.array(F.lit("core")))
    had = passed.select("skill_id", F.explode(F.array_append(given, F.lit("any"))).alias("requirement"))
    counts = had.groupBy("skill_id", "requirement").agg(F.count(F.lit(1)).alias("have"))
    need = (F.col("least") - F.coalesce("have", F.lit(0))).cast("int").alias("need")
    return minimums.join(counts, ["skill_id", "requirement"], "left").select("skill_id", "requirement", need).filter("need > 0")


def patched_targets(rows: DataFrame, replaced: DataFrame, curated: DataFrame) -> DataFrame:
    """``query_id, skill_ids, ...``: rows without those that target a replaced skill, and the curated rows instead.

    ``replaced(skill_id)``. A curated row takes the place of a kept row of its id.
    """
    hit = rows.select("query_id", F.explode("skill_ids").alias("skill_id")).join(replaced.select("skill_id"), "skill_id", "left_semi")
    kept = rows.join(hit.select("query_id").distinct(), "query_id", "left_anti").join(curated.select("query_id"), "query_id", "left_anti")
    return kept.unionByName(curated, allowMissingColumns=True)


def coverage_shortfall(rows: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    """``skill_id, have`` of catalog skills that fewer than ``least`` rows target; to check after a patch."""
    counts = rows.select(F.explode(F.array_distinct("skill_ids")).alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("have"))
    joined = catalog.select("skill_id").join(counts, "skill_id", "left").withColumn("have", F.coalesce("have", F.lit(0)).cast("int"))
    return joined.filter(F.col("have") < least)


def lineage_violations(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    """Artifacts ``name, trained_on`` whose manifest hash is neither the current one of ``manifests(name, current,
    ancestors)`` nor one of its ancestors', and those without a manifest."""
    joined = artifacts.join(manifests, "name", "left")
    known = (F.col("trained_on") == F.col("current")) | F.array_contains("ancestors", F.col("trained_on"))
    why = F.when(F.col("current").isNull(), "no manifest").when(~F.coalesce(known, F.lit(False)), "unknown lineage")
    return joined.withColumn("reason", why).filter("reason is not null").select("name", "reason")
