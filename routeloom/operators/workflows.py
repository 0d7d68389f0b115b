"""Workflows of collaborating skills: construction, recovery, coverage, and normalized queries."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from routeloom.functions.hashing import short_digest

#: Order of roles in a workflow, and directed pairs of roles that follow one another.
ROLE_ORDER = {
    "protect": 0, "meta": 0, "retrieve": 1, "perceive": 1, "monitor": 2, "analyze": 3, "plan": 4, "create": 5,
    "schedule": 6, "act": 7, "automate": 7, "communicate": 8, "store": 8,
}
ROLE_EDGES = {
    ("retrieve", "analyze"), ("retrieve", "plan"), ("retrieve", "create"), ("retrieve", "communicate"), ("retrieve", "store"),
    ("perceive", "analyze"), ("perceive", "create"), ("perceive", "store"), ("analyze", "plan"), ("analyze", "create"),
    ("analyze", "communicate"), ("analyze", "store"), ("plan", "schedule"), ("plan", "act"), ("plan", "communicate"),
    ("create", "communicate"), ("create", "store"), ("create", "act"), ("schedule", "act"), ("schedule", "communicate"),
    ("monitor", "analyze"), ("monitor", "communicate"), ("protect", "act"), ("protect", "store"), ("meta", "act"),
    ("meta", "automate"), ("automate", "monitor"), ("automate", "communicate"),
}
#: The domains next to each domain.
DOMAIN_NEIGHBORS = {
    "travel_local": {"weather_environment", "shopping_food", "productivity_planning", "communication"},
    "weather_environment": {"travel_local", "health_fitness", "smart_home_iot", "news_research"},
    "productivity_planning": {"communication", "documents_office", "business_operations", "health_fitness"},
    "communication": {"productivity_planning", "documents_office", "social_content", "business_operations"},
    "documents_office": {"data_analysis", "communication", "business_operations", "files_knowledge_memory"},
    "data_analysis": {"documents_office", "finance_investment", "business_operations", "health_fitness"},
    "media_image_design": {"media_audio_video", "social_content", "documents_office", "shopping_food"},
    "media_audio_video": {"media_image_design", "social_content", "communication", "files_knowledge_memory"},
    "health_fitness": {"weather_environment", "productivity_planning", "data_analysis", "shopping_food"},
    "finance_investment": {"news_research", "data_analysis", "documents_office", "communication"},
    "news_research": {"finance_investment", "education_knowledge", "social_content", "documents_office"},
    "shopping_food": {"travel_local", "finance_investment", "media_image_design", "health_fitness"},
    "smart_home_iot": {"weather_environment", "agent_system_automation", "security_privacy", "productivity_planning"},
    "social_content": {"media_image_design", "media_audio_video", "news_research", "communication"},
    "education_knowledge": {"news_research", "documents_office", "media_audio_video", "productivity_planning"},
    "software_development": {"security_privacy", "agent_system_automation", "business_operations", "files_knowledge_memory"},
    "business_operations": {"documents_office", "data_analysis", "communication", "software_development"},
    "security_privacy": {"software_development", "smart_home_iot", "agent_system_automation", "files_knowledge_memory"},
    "files_knowledge_memory": {"documents_office", "agent_system_automation", "software_development", "media_audio_video"},
    "agent_system_automation": {"productivity_planning", "software_development", "security_privacy", "smart_home_iot"},
}


@dataclass
class Profile:
    skill_id: str
    rank: int
    domain: str
    roles: frozenset[str]
    features: frozenset[str]
    mobile_fit: str = "medium"
    place: int = field(init=False)

    def __post_init__(self) -> None:
        self.place = min((ROLE_ORDER.get(r, 99) for r in self.roles), default=99)

    def likeness(self, other: Profile) -> float:
        union = len(self.features | other.features)
        return len(self.features & other.features) / union if self.features and other.features else 0.0


def role_fit(a: frozenset[str], b: frozenset[str]) -> float:
    """Pairs of roles that follow one another, less equal or common roles."""
    follows = sum(((x, y) in ROLE_EDGES) or ((y, x) in ROLE_EDGES) for x in a for y in b)
    return 2.5 * follows - (5.0 if a == b else 1.0 if a & b else 0.0)


class Builder:
    """Greedy construction: each anchor gets a workflow in each round, completed by the best free collaborators.

    The choice depends on how often every skill was used before, so it is one sequence; the catalog is a closed set
    of at most ``most`` skills, and the whole of it is one task's work.
    """

    POOL, GUARD = 256, 0.72

    def __init__(self, profiles: list[Profile], rounds: int, seed: int) -> None:
        self.profiles, self.rounds, self.seed = sorted(profiles, key=lambda p: p.rank), rounds, seed
        self.used: Counter[str] = Counter()
        self.seen: set[frozenset[str]] = set()
        self.sizes = ([2, 3, 4, 3] + [2 + k % 3 for k in range(4, rounds)])[:rounds]

    def score(self, new: Profile, chosen: list[Profile], turn: int) -> float:
        total = 0.0
        for old in chosen:
            if new.domain == old.domain:
                total += 2.5 if turn in (0, 2) else 0.5
            elif new.domain in DOMAIN_NEIGHBORS.get(old.domain, ()):
                total += 3.5 if turn in (1, 3) else 2.0
            else:
                total -= 1.5
            total += role_fit(old.roles, new.roles) - 14.0 * max(0.0, new.likeness(old) - 0.25)
        if new.mobile_fit == "high":
            total += 1.5
        elif new.mobile_fit == "low" and any(p.mobile_fit == "low" for p in chosen):
            total -= 1.0
        jitter = (new.rank * 1_103_515_245 + self.seed + turn * 12_345 + len(chosen) * 97) & 0xFFFF
        return total - 0.16 * self.used[new.skill_id] + jitter / 655_360

    def pool(self, chosen: list[Profile], turn: int, size: int) -> list[Profile]:
        """The least used skills of the chosen ones' domains and their neighbours."""
        have = {p.skill_id for p in chosen}
        domains = {p.domain for p in chosen}.union(*(DOMAIN_NEIGHBORS.get(p.domain, ()) for p in chosen))
        rest = [p for p in self.profiles if p.skill_id not in have]
        near = [p for p in rest if p.domain in domains]
        order = lambda p: (self.used[p.skill_id], (p.rank * 1_103_515_245 + self.seed + turn * 97) & 0xFFFF)
        return sorted(near if len(near) >= size - len(chosen) else rest, key=order)[: self.POOL]

    def complete(self, anchor: Profile, turn: int) -> list[Profile]:
        chosen, size = [anchor], self.sizes[turn]
        while len(chosen) < size:
            ids = {p.skill_id for p in chosen}
            pool = self.pool(chosen, turn, size)
            last = len(chosen) + 1 == size
            free = [
                p
                for p in pool
                if not (last and frozenset(ids | {p.skill_id}) in self.seen)
                and not any(p.roles == o.roles and p.likeness(o) > self.GUARD for o in chosen)
            ]
            if not (free or pool):
                raise ValueError(f"no collaborator is left for {anchor.skill_id}")
            chosen.append(max(free or pool, key=lambda p: (self.score(p, chosen, turn), -p.rank)))
        self.seen.add(frozenset(p.skill_id for p in chosen))
        self.used.update(p.skill_id for p in chosen)
        return sorted(chosen, key=lambda p: (p.place, p.rank, p.skill_id))

    def rows(self) -> Iterator[tuple]:
        for anchor in self.profiles:
            for turn in range(self.rounds):
                chosen = self.complete(anchor, turn)
                ids = [p.skill_id for p in chosen]
                digest = hashlib.sha256("\x1f".join([anchor.skill_id, str(turn), *sorted(ids)]).encode()).hexdigest()[:16]
                domains = list(dict.fromkeys(p.domain for p in chosen))
                yield f"wf-{digest}", anchor.skill_id, turn, ids, domains, len(domains) > 1


WORKFLOW = "workflow_id string, anchor_skill_id string, anchor_round int, skill_ids array<string>, domains array<string>, cross_domain boolean"


def built_workflows(profiles: DataFrame, rounds: int = 5, seed: int = 0, most: int = 20_000) -> DataFrame:
    """Workflows of ``profiles(skill_id, rank, domain, roles, features, mobile_fit)``; a catalog above ``most`` is an error."""
    if profiles.limit(most + 1).count() > most:
        raise ValueError(f"the catalog has more than {most} skills")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = [Profile(r.skill_id, int(r["rank"]), r.domain, frozenset(r.roles), frozenset(r.features), r.mobile_fit) for _, r in part.iterrows()]
        return pd.DataFrame(list(Builder(own, rounds, seed).rows()), columns=[c.split()[0] for c in WORKFLOW.split(", ")])

    rows = profiles.select(F.col("skill_id").cast("string"), "rank", "domain", "roles", "features", "mobile_fit")
    return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(run, WORKFLOW)


def recovered_workflows(specs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train-only workflows of configured sets ``spec, anchor_skill_id, collaborator_skill_ids``, and violations.

    Two to four distinct known skills each, and no set twice.
    """
    ids = F.array_distinct(F.filter(F.concat(F.array("anchor_skill_id"), "collaborator_skill_ids"), lambda x: x.isNotNull() & (x != "")))
    rows = specs.select("spec", "anchor_skill_id", ids.alias("ids"))
    known = profiles.select("skill_id", "rank", "roles", F.lit(True).alias("known"))
    each = rows.select("spec", F.explode("ids").alias("skill_id")).join(known, "skill_id", "left")
    place = F.array_min(F.transform("roles", role_place))
    lists = each.groupBy("spec").agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"), F.array_sort(F.collect_list(F.struct(place.alias("p"), "rank", "skill_id"))).alias("l")
    )
    joined = rows.join(lists, "spec").withColumn("n", F.size("ids")).withColumn("set", F.array_sort("ids"))
    first = joined.groupBy("set").agg(F.min("spec").alias("first"))
    joined = joined.join(first, "set")
    why = F.when(~F.col("all_known"), "unknown skill").when(~F.col("n").between(2, 4), "number of skills").when(F.col("spec") != F.col("first"), "set twice")
    judged = joined.withColumn("why", why)
    name = F.concat(F.lit("wf-r"), short_digest(F.array_join("set", "\x1f"), 16))
    good = judged.filter("why is null").select(name.alias("workflow_id"), "anchor_skill_id", F.col("l.skill_id").alias("skill_ids"), F.lit("train").alias("split"))
    return good, judged.filter("why is not null").select("spec", "why")


def role_place(role: Column) -> Column:
    order = F.create_map(*(F.lit(x) for kv in ROLE_ORDER.items() for x in kv))
    return F.coalesce(F.try_element_at(order, role), F.lit(99))


def normalized_queries(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """``query_id, query, skill_ids, k``: known targets in order, each once; queries without id or target go."""
    rows = queries.filter(F.trim(F.coalesce(F.col("query_id").cast("string"), F.lit(""))) != "")
    each = rows.select("query_id", F.posexplode("skill_ids").alias("at", "skill_id")).join(catalog.select("skill_id").distinct(), "skill_id", "left_semi")
    firsts = each.groupBy("query_id", "skill_id").agg(F.min("at").alias("at"))
    lists = firsts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "skill_id"))).alias("l"))
    joined = rows.select("query_id", F.coalesce("query", F.lit("")).alias("query")).join(lists, "query_id")
    return joined.select("query_id", "query", F.col("l.skill_id").alias("skill_ids"), F.size("l").alias("k"))


def parsed_payloads(responses: DataFrame, requested: DataFrame, variants: int) -> tuple[DataFrame, DataFrame]:
    """Variants ``workflow_id, variant, query`` of whole items of JSON responses, and ``workflow_id, why`` of the rest.

    ``responses(batch, body)`` hold ``{"items": [{"workflow_id", "variants": [{"query"}]}]}``, ``requested(batch,
    workflow_id)``. An item is whole when it was asked for, has all its variants and no query twice.
    """
    from routeloom.functions.text import json_object

    kind = "items array<struct<workflow_id:string,variants:array<struct<query:string>>>>"
    items = responses.select("batch", F.explode_outer(F.from_json(json_object(F.col("body")), kind)["items"]).alias("item"))
    items = items.select("batch", F.col("item.workflow_id").alias("workflow_id"), F.col("item.variants.query").alias("queries"))
    both = requested.select("batch", "workflow_id", F.lit(True).alias("asked")).join(items.filter("workflow_id is not null"), ["batch", "workflow_id"], "full_outer")
    n = F.size(F.coalesce("queries", F.array().cast(ArrayType(StringType()))))
    why = (
        F.when(F.col("asked").isNull(), "not requested")
        .when(n == 0, "missing")
        .when(n != variants, "variant count")
        .when(F.size(F.array_distinct("queries")) != n, "variant twice")
    )
    judged = both.withColumn("why", why)
    good = judged.filter("why is null").select("workflow_id", F.posexplode("queries").alias("variant", "query"))
    return good, judged.filter("why is not null").select("workflow_id", "why")


def coverage_failures(rows: DataFrame, catalog: DataFrame, least: int) -> DataFrame:
    """``skill_id, n`` of skills with fewer than ``least`` train rows ``(split, skill_ids)``."""
    counts = rows.filter("split = 'train'").select(F.explode(F.array_distinct("skill_ids")).alias("skill_id")).groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    joined = catalog.select("skill_id").join(counts, "skill_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.filter(F.col("n") < least)


def exported(queries: DataFrame, reviews: DataFrame, split: Column) -> DataFrame:
    """``query_id, workflow_id, query, skill_ids, split`` of the queries whose review passed; no review is no pass."""
    passed = reviews.select("query_id", F.col("pass").alias("__pass"))
    joined = queries.join(passed, "query_id", "left").filter(F.coalesce("__pass", F.lit(False))).drop("__pass")
    return joined.withColumn("split", split)


def manifest(rows: DataFrame) -> str:
    """A JSON summary of exported rows: counts by split, targets and workflows."""
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("workflow_id").alias("workflows"), F.avg(F.size("skill_ids")).alias("targets"))
    return json.dumps({r.split: {"rows": r.rows, "workflows": r.workflows, "targets": round(r.targets, 6)} for r in per.orderBy("split").collect()})


def recall_by_frequency(predicted: DataFrame, gold: DataFrame, train_counts: DataFrame) -> DataFrame:
    """``bin, pairs, recall``: judged pairs that a prediction has, by how often training named the skill."""
    from routeloom.operators.joins import FREQUENCY_BINS, binned

    hit = predicted.select("query_id", "skill_id").distinct().withColumn("hit", F.lit(1.0))
    joined = gold.join(train_counts.select("skill_id", "n"), "skill_id", "left").join(hit, ["query_id", "skill_id"], "left")
    rows = binned(joined.withColumn("n", F.coalesce("n", F.lit(0))), "n", FREQUENCY_BINS)
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
