"""Validation as data: every rule gives rows ``rule, key, detail``, and a dataset is valid when there are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeloom.functions import text as t


class ValidationError(ValueError):
    """A dataset breaks its rules; the message names the first violations in order."""


def violation(rows: DataFrame, rule: str, key: Column, detail: Column | str = "") -> DataFrame:
    what = F.lit(detail) if isinstance(detail, str) else detail
    return rows.select(F.lit(rule).alias("rule"), F.coalesce(key.cast("string"), F.lit("")).alias("key"), what.cast("string").alias("detail"))


def require_valid(violations: DataFrame, show: int = 5) -> None:
    """Raise if there are violations. At most ``show`` rows reach the driver."""
    first = violations.orderBy("rule", "key", "detail").limit(show).collect()
    if first:
        raise ValidationError("; ".join(f"{r['rule']}: {r['key']} {r['detail']}".strip() for r in first))


def duplicates(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    repeated = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return violation(repeated, rule, F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def blanks(rows: DataFrame, column: str, key: str, rule: str) -> DataFrame:
    return violation(rows.filter(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""), rule, F.col(key))


def unknown(rows: DataFrame, known: DataFrame, column: str, rule: str) -> DataFrame:
    return violation(rows.select(column).distinct().join(known.select(F.col(known.columns[0]).alias(column)), column, "left_anti"), rule, F.col(column))


def overlaps(left: DataFrame, right: DataFrame, column: str, rule: str) -> DataFrame:
    return violation(left.select(column).distinct().join(right.select(column), column, "left_semi"), rule, F.col(column))


def dataset_violations(skills: DataFrame, queries: DataFrame, qrels: DataFrame, held_queries: DataFrame) -> DataFrame:
    """Rules of a raw dataset: unique and filled ids, known positives, unique judgements that equal the queries' lists,
    and no query in two splits.

    ``skills(skill_id)``, ``queries(query_id, query, skill_ids)``, ``qrels(query_id, skill_id)``, ``held_queries(query_id)``.
    """
    wanted = queries.select("query_id", F.array_sort(F.array_distinct("skill_ids")).alias("want"))
    judged = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("skill_id")).alias("have"))
    unequal = wanted.join(judged, "query_id", "full_outer").filter(~F.col("want").eqNullSafe(F.col("have")))
    listed = queries.select(F.explode("skill_ids").alias("skill_id"))
    rules = [
        duplicates(skills, ["skill_id"], "duplicate skill"),
        blanks(skills, "skill_id", "skill_id", "blank skill id"),
        duplicates(queries, ["query_id"], "duplicate query"),
        blanks(queries, "query", "query_id", "blank query"),
        duplicates(qrels, ["query_id", "skill_id"], "duplicate judgement"),
        unknown(listed, skills, "skill_id", "unknown target"),
        unknown(qrels, skills, "skill_id", "unknown judged skill"),
        violation(unequal, "judgements differ from targets", F.col("query_id")),
        overlaps(queries, held_queries, "query_id", "query in two splits"),
    ]
    return reduce(DataFrame.unionByName, rules)


def code_violations(codes: DataFrame) -> DataFrame:
    """Rules of code rows ``skill_id, tokens``: one length, at least one token, none twice in a row, no skill twice."""
    sized = codes.withColumn("n", F.size("tokens"))
    usual = sized.agg(F.min("n").alias("least"))
    rules = [
        violation(sized.crossJoin(F.broadcast(usual)).filter("n <> least"), "uneven length", F.col("skill_id"), F.col("n")),  # one row
        violation(sized.filter("n < 1"), "no tokens", F.col("skill_id")),
        violation(sized.filter(F.size(F.array_distinct("tokens")) != F.col("n")), "repeated token", F.col("skill_id")),
        violation(sized.filter(F.exists("tokens", lambda x: x.rlike(r"\s") | (x == ""))), "blank in token", F.col("skill_id")),
        duplicates(codes, ["skill_id"], "duplicate skill"),
    ]
    return reduce(DataFrame.unionByName, rules)


def registry_violations(registry: DataFrame, codes: DataFrame) -> DataFrame:
    """Skills whose bucket ``(path, skills)`` isn't the path of their code ``(skill_id, path)``, or that only one side has."""
    members = registry.select(F.col("path").alias("bucket"), F.explode("skills").alias("skill_id"))
    both = members.join(codes.select("skill_id", "path"), "skill_id", "full_outer")
    wrong = both.filter(~F.col("bucket").eqNullSafe(F.col("path")))
    return violation(wrong, "registry differs from codes", F.col("skill_id"), F.concat_ws(" <> ", F.coalesce("bucket", F.lit("-")), F.coalesce("path", F.lit("-")))).unionByName(
        duplicates(members, ["skill_id"], "skill in two buckets")
    )


def closed_set_violations(queries: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """Rules of generated rows ``query_id, workflow_id, split, query, skill_ids, evidence (map)``.

    Two to four distinct targets, evidence for exactly the targets, verbatim in the query, a workflow in one split
    only, and equal target sets in all variants of a workflow.
    """
    n = F.size(F.array_distinct("skill_ids"))
    keys = F.array_sort(F.map_keys("evidence"))
    absent = F.filter(F.map_values("evidence"), lambda s: ~F.coalesce(F.contains("query", s), F.lit(False)))
    per = queries.groupBy("workflow_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct(F.array_sort("skill_ids")).alias("sets"))
    rules = [
        duplicates(queries, ["query_id"], "duplicate query"),
        violation(queries.filter((n < least) | (n > most) | (n != F.size("skill_ids"))), "number of targets", F.col("query_id"), n),
        violation(queries.filter(keys != F.array_sort("skill_ids")), "evidence keys", F.col("query_id")),
        violation(queries.filter(F.size(absent) > 0), "evidence not in query", F.col("query_id"), F.array_join(absent, "; ")),
        violation(per.filter("splits > 1"), "workflow in two splits", F.col("workflow_id")),
        violation(per.filter("sets > 1"), "targets differ in workflow", F.col("workflow_id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def intent_violations(queries: DataFrame) -> DataFrame:
    """Rules of the intents of rows ``query_id, skill_ids, intent_mode, implicit_ids, target_intents (map), rationales (map)``.

    A mode of two; implicit ids among the targets; intents of exactly the targets that agree with the implicit ids (null:
    not given); rationales of exactly the implicit ids; an explicit query has none, an implicit one some and not all.
    """
    mode = F.coalesce("intent_mode", F.lit("explicit"))
    implicit = F.coalesce("implicit_ids", F.array().cast(queries.schema["skill_ids"].dataType))
    targets = F.array_sort(F.array_distinct("skill_ids"))
    of_map = lambda c: F.array_sort(F.coalesce(F.map_keys(c), F.array().cast(queries.schema["skill_ids"].dataType)))
    wrong = F.map_filter("target_intents", lambda k, v: v != F.when(F.array_contains(implicit, k), "implicit").otherwise("explicit"))
    n = F.size(implicit)
    rules = (
        (~mode.isin("explicit", "implicit"), "intent mode"),
        (F.size(F.array_except(implicit, "skill_ids")) > 0, "implicit skill is no target"),
        (F.col("target_intents").isNotNull() & (of_map("target_intents") != targets), "intents of other than the targets"),
        (F.coalesce(F.size(F.map_keys(wrong)), F.lit(0)) > 0, "intents disagree with implicit skills"),
        (of_map("rationales") != F.array_sort(F.array_distinct(implicit)), "rationales of other than the implicit skills"),
        ((mode == "explicit") & (n > 0), "explicit query with implicit skills"),
        ((mode == "implicit") & ~n.between(1, F.size(targets) - 1), "implicit query without both kinds"),
    )
    return reduce(DataFrame.unionByName, (violation(queries.filter(broken), rule, F.col("query_id")) for broken, rule in rules))


def count_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names ``name, n`` whose number of rows isn't what the manifest says, or that only one side has."""
    both = found.select("name", F.col("n").alias("found")).join(manifest.select("name", F.col("n").alias("said")), "name", "full_outer")
    wrong = both.filter(~F.col("found").eqNullSafe(F.col("said")))
    shown = F.concat_ws(" <> ", F.coalesce(F.col("found").cast("string"), F.lit("-")), F.coalesce(F.col("said").cast("string"), F.lit("-")))
    return violation(wrong, "count differs from manifest", F.col("name"), shown)


def alignment_violations(queries: DataFrame, qrels: DataFrame, skills: DataFrame) -> DataFrame:
    """Rules of single-target queries ``query_id, skill_ids`` and their judgements ``query_id, skill_id, relevance``: ids once,
    one known target each, and for each query exactly the judgement of its target, positive and once."""
    single = queries.filter(F.size("skill_ids") == 1).select("query_id", F.get("skill_ids", F.lit(0)).alias("skill_id"))
    good = qrels.filter(F.coalesce("relevance", F.lit(1)) > 0)
    rules = [
        duplicates(queries, ["query_id"], "duplicate query"),
        violation(queries.filter(F.size("skill_ids") != 1), "number of targets", F.col("query_id"), F.size("skill_ids")),
        unknown(single, skills, "skill_id", "unknown target"),
        duplicates(qrels, ["query_id", "skill_id"], "duplicate judgement"),
        violation(qrels.filter(F.coalesce("relevance", F.lit(1)) <= 0), "judgement isn't positive", F.col("query_id")),
        violation(good.join(single, ["query_id", "skill_id"], "left_anti"), "judgement of no target", F.col("query_id")),
        violation(single.join(good, ["query_id", "skill_id"], "left_anti"), "target without judgement", F.col("query_id")),
    ]
    return reduce(DataFrame.unionByName, rules)


def underfed_skills(train: DataFrame, alignment: DataFrame, skills: DataFrame, least: int) -> DataFrame:
    """Skills with fewer than ``least`` positives: targets of distinct source queries ``query_id, source_query_id, skill_ids``
    in training, and of alignment queries ``skill_ids``."""
    source = train.select(F.coalesce("source_query_id", "query_id").alias("source"), F.explode("skill_ids").alias("skill_id")).distinct()
    counts = source.select("skill_id").union(alignment.select(F.explode("skill_ids"))).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    joined = skills.select("skill_id").join(counts, "skill_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return violation(joined.filter(F.col("n") < least), "too few positives", F.col("skill_id"), F.col("n"))


def text_violations(rows: DataFrame, key: str, text: str, shortest: int, longest: int, cjk_least: int, cjk_share: float, banned: list[str]) -> DataFrame:
    """Length, banned phrases, identifier leaks and the share of CJK characters of generated texts."""
    c = F.col(text)
    has_banned = F.lit(False)
    for phrase in banned:
        has_banned = has_banned | c.contains(phrase)
    rules = [
        violation(rows.filter((F.length(c) < shortest) | (F.length(c) > longest)), "length", F.col(key), F.length(c)),
        violation(rows.filter(has_banned), "banned phrase", F.col(key)),
        violation(rows.filter(t.leaks_identifier(c)), "identifier leak", F.col(key)),
        violation(rows.filter((t.cjk_count(c) < cjk_least) | (t.cjk_ratio(c) < cjk_share)), "script share", F.col(key)),
    ]
    return reduce(DataFrame.unionByName, rules)


def multi_target_pass(scores: Column, missing: Column, redundant: Column, unsafe: Column, issues: Column) -> Column:
    """A multi-target review passes: style and specificity 3, complexity, necessity and coherence 4, nothing amiss."""
    at = lambda k, n: F.coalesce(scores[k] >= n, F.lit(False))
    clean = (F.size(missing) == 0) & (F.size(redundant) == 0) & ~F.coalesce(unsafe, F.lit(False)) & (F.size(issues) == 0)
    return at("style", 3) & at("complexity", 4) & at("necessity", 4) & at("coherence", 4) & at("specificity", 3) & clean


def single_target_pass(scores: Column, satisfied: Column, missing: Column, extra: Column, unsafe: Column) -> Column:
    """A single-target review passes: style and specificity 3, relevance and coherence 4, and its flags are as they should be.

    The requirement is satisfied, nothing is missing, no extra capability is needed, nothing is unsafe. A score or
    ``satisfied`` that is null fails; the other flags count as false if null.
    """
    at = lambda k, n: F.coalesce(scores[k] >= n, F.lit(False))
    amiss = F.coalesce(missing, F.lit(False)) | F.coalesce(extra, F.lit(False)) | F.coalesce(unsafe, F.lit(False))
    return at("style", 3) & at("relevance", 4) & at("specificity", 3) & at("coherence", 4) & F.coalesce(satisfied, F.lit(False)) & ~amiss


def normalized_list(values: Column, most: int, longest: int) -> Column:
    """Trimmed, non-blank, distinct entries of at most ``longest`` characters, the first ``most``."""
    clean = F.filter(F.transform(values, lambda x: t.collapsed(x)), lambda x: (x != "") & (F.length(x) <= longest))
    return F.slice(F.array_distinct(clean), 1, most)


def profile_violations(profiles: DataFrame, domains: list[str], roles: list[str]) -> DataFrame:
    """Enumerations and list bounds of skill profiles ``skill_id, domain, roles, facets, triggers``."""
    rules = [
        violation(profiles.filter(~F.coalesce(F.col("domain").isin(domains), F.lit(False))), "domain", F.col("skill_id"), F.col("domain")),
        violation(profiles.filter(F.size(F.array_except("roles", F.lit(roles))) > 0), "role", F.col("skill_id")),
        violation(profiles.filter(~F.size("roles").between(1, 3)), "number of roles", F.col("skill_id"), F.size("roles")),
        violation(profiles.filter(~F.size("facets").between(1, 10)), "number of facets", F.col("skill_id"), F.size("facets")),
        violation(profiles.filter(~F.size("triggers").between(2, 8)), "number of triggers", F.col("skill_id"), F.size("triggers")),
    ]
    return reduce(DataFrame.unionByName, rules)


def decode_map_violations(skills: DataFrame, codes: DataFrame, paths: DataFrame, supervised: DataFrame) -> DataFrame:
    """Coverage of a decode map: every skill has a code, every code a path and every path a code, every skill rows to learn from."""
    rules = [
        unknown(skills, codes.select("skill_id"), "skill_id", "skill without code"),
        unknown(codes.select("path"), paths.select("path"), "path", "code without path"),
        unknown(paths.select("path"), codes.select("path"), "path", "path without code"),
        unknown(skills, supervised.select("skill_id"), "skill_id", "skill without supervision"),
    ]
    return reduce(DataFrame.unionByName, rules)
