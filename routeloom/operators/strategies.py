"""Code strategies behind one surface: fit, encode, add, remove, decode, next tokens, snapshot and restore.

State is three tables: members with their codes, the fitted codebook state, and nothing else. Every change makes new
tables and takes their place only when it succeeded, so a failed fit or add leaves the strategy as it was.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routeloom.operators import codes, decoding
from routeloom.storage import materialize


class Strategy(ABC):
    """A way to give codes to skills ``skill_id`` plus what the strategy needs."""

    name = ""

    def __init__(self, capacity: int | None = None) -> None:
        self.capacity = capacity
        self.members: DataFrame | None = None

    @abstractmethod
    def _fit(self, skills: DataFrame) -> DataFrame:
        """``skill_id, indices`` of all skills, after the codebook state was set."""

    @abstractmethod
    def _encode(self, skills: DataFrame) -> DataFrame:
        """``skill_id, indices`` of skills under the frozen codebook."""

    @abstractmethod
    def state(self) -> dict:
        """What ``restore`` needs besides the members."""

    @abstractmethod
    def _restore(self, state: dict) -> None: ...

    def fit(self, skills: DataFrame) -> Strategy:
        before = self.state()
        try:
            self.members = self._checked(self._fit(skills))
        except Exception:
            self._restore(before)
            raise
        return self

    def _checked(self, members: DataFrame) -> DataFrame:
        members = materialize(members.select("skill_id", "indices"), "members")
        if members.groupBy("skill_id").count().filter("count > 1").limit(1).count():
            raise ValueError("a skill has two codes")
        if self.capacity is not None and members.groupBy("indices").count().filter(F.col("count") > self.capacity).limit(1).count():
            raise ValueError("a code has more skills than its capacity")
        return members

    def _fitted(self) -> DataFrame:
        if self.members is None:
            raise ValueError("the strategy is not fitted")
        return self.members

    def encode(self, skills: DataFrame) -> DataFrame:
        """Known skills keep their code; others get a preview, which changes nothing."""
        known = self._fitted()
        new = skills.join(known.select("skill_id"), "skill_id", "left_anti")
        return known.join(skills.select("skill_id"), "skill_id", "left_semi").unionByName(self._encode(new))

    def add(self, skills: DataFrame) -> Strategy:
        known = self._fitted()
        if skills.join(known, "skill_id", "left_semi").limit(1).count():
            raise ValueError("a skill is there already")
        self.members = self._checked(known.unionByName(self._encode(skills)))
        return self

    def remove(self, ids: DataFrame) -> Strategy:
        """Members leave; codes and codebook stay as they are."""
        self.members = materialize(self._fitted().join(ids.select("skill_id"), "skill_id", "left_anti"), "members")
        return self

    def decode(self, prefix: list[int]) -> DataFrame:
        """Members whose code starts with the prefix."""
        rows = self._fitted()
        return rows.filter(F.slice("indices", 1, len(prefix)) == F.array(*map(F.lit, prefix))) if prefix else rows

    def next_tokens(self) -> DataFrame:
        """``prefix, allowed`` of the members' codes."""
        return decoding.prefix_table(self._fitted().select(F.col("indices").alias("tokens")))

    def save(self, path: str) -> None:
        self._fitted().write.mode("overwrite").parquet(f"{path}/members")
        meta = json.dumps({"strategy": self.name, "capacity": self.capacity, "state": self.state()})
        self._fitted().sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


class Taxonomy(Strategy):
    """Codes by label paths: the place of each label under its prefix; later labels take the next places."""

    name = "taxonomy"

    def __init__(self, labels: list[str] | None = None, limit: int = 1 << 20, capacity: int | None = None) -> None:
        super().__init__(capacity)
        self.labels, self.limit, self.slots = labels or [], limit, None

    def _fit(self, skills: DataFrame) -> DataFrame:
        self.slots = {}
        return self._placed(skills)

    def _encode(self, skills: DataFrame) -> DataFrame:
        before = json.dumps(self.slots)
        try:
            return materialize(self._placed(skills), "codes")
        except Exception:
            self.slots = json.loads(before)
            raise

    def _placed(self, skills: DataFrame) -> DataFrame:
        """Extends the label slots, a table of the taxonomy's size, by the labels of the skills in sorted order."""
        paths = sorted(tuple(r) for r in skills.select(*self.labels).distinct().collect())
        for path in paths:
            for d in range(len(path)):
                under = self.slots.setdefault("\x1f".join(path[:d]), {})
                if path[d] not in under:
                    if len(under) >= self.limit:
                        raise ValueError(f"no slot is left for {path[d]!r}")
                    under[path[d]] = len(under)
        rows = [(*p, [self.slots["\x1f".join(p[:d])][p[d]] for d in range(len(p))]) for p in paths]
        kinds = ", ".join(f"`{c}` string" for c in self.labels)
        table = skills.sparkSession.createDataFrame(rows, f"{kinds}, indices array<int>")
        return skills.join(table, self.labels).select("skill_id", "indices")

    def state(self) -> dict:
        return {"labels": self.labels, "limit": self.limit, "slots": json.loads(json.dumps(self.slots))}

    def _restore(self, state: dict) -> None:
        self.labels, self.limit, self.slots = state["labels"], state["limit"], state["slots"]


class Balanced(Strategy):
    """Residual codes with exact floor or ceiling usage in every level; later skills go to the nearest code."""

    name = "balanced"

    def __init__(self, sizes: list[int] | None = None, iterations: int = 6, seed: int = 0, capacity: int | None = None) -> None:
        super().__init__(capacity)
        self.sizes, self.iterations, self.seed, self.books = sizes or [], iterations, seed, []

    def _fit(self, skills: DataFrame) -> DataFrame:
        books, rest = [], skills.select("skill_id", F.col("vector").cast("array<double>").alias("vector"))
        for size in self.sizes:
            centers, coded = codes.fit_codebook(rest, size, self.iterations, self.seed, "skill_id", "vector")
            books.append(centers)
            center = F.get(F.lit([list(map(float, c)) for c in centers]), F.col("code"))
            rest = materialize(rest.join(coded, "skill_id").select("skill_id", F.zip_with("vector", center, lambda x, y: x - y).alias("vector")), "residuals")
        self.books = books
        return codes.balanced_hierarchical_codes(skills, books, "skill_id", "vector")

    def _encode(self, skills: DataFrame) -> DataFrame:
        return codes.residual_codes(skills, self.books, "skill_id", "vector").select("skill_id", "indices")

    def state(self) -> dict:
        return {"sizes": self.sizes, "iterations": self.iterations, "seed": self.seed, "books": self.books}

    def _restore(self, state: dict) -> None:
        self.sizes, self.iterations, self.seed, self.books = (state[k] for k in ("sizes", "iterations", "seed", "books"))


STRATEGIES: dict[str, type[Strategy]] = {s.name: s for s in (Taxonomy, Balanced)}


def create(name: str, **options) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name](**options)


def load(spark, path: str) -> Strategy:
    meta = json.loads(spark.read.text(f"{path}/state").first()[0])
    found = create(meta["strategy"], capacity=meta["capacity"])
    found._restore(meta["state"])
    found.members = spark.read.parquet(f"{path}/members")
    return found
