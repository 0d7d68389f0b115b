"""Operators against literal expectations and invariants."""

import hashlib
import itertools
import math
import time

import pytest
from pyspark.sql import functions as F

from routeloom.functions import hashing, text, vectors
from routeloom.operators import codes, decoding, documents, graphs, joins, logs, ranking, similarity, splits, summaries, validation
from tests.compare import DATA


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_couse_edges_ignore_repeats(spark):
    qrels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q1", "b"), ("q1", "c"), ("q2", "a"), ("q2", "b")], "query_id string, skill_id string")
    found = {(r.src, r.dst): r.weight for r in graphs.couse_edges(qrels).collect()}
    assert found == {("a", "b"): pytest.approx(1.0), ("a", "c"): pytest.approx(1 / math.sqrt(2)), ("b", "c"): pytest.approx(1 / math.sqrt(2))}


def test_edges_coalesce_and_induce(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (0, 0, 9.0), (1, 2, 1.0), (2, 3, 1.0), (1, 3, 0.0)], "src int, dst int, weight double")
    one = graphs.coalesced_edges(edges)
    assert rows(one, "src", "dst") == [(0, 1, 3.0), (1, 2, 1.0), (2, 3, 1.0)]
    nodes = spark.createDataFrame([(0,), (1,), (3,)], "node int")
    assert rows(graphs.induced_edges(one, nodes), "src") == [(0, 1, 3.0)]


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", 0, "a"), ("q", 1, "x"), ("q", 2, "b")], "query_id string, rank int, skill_id string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("none", "z")], "query_id string, skill_id string")
    found = {(r.query_id, r.k): r for r in ranking.query_metrics(ranked, relevant, [1, 3]).collect()}
    one, three = found["q", 1], found["q", 3]
    assert (one.recall, one.ndcg, one.map, one.mrr, one.completeness) == (0.5, 1.0, 1.0, 1.0, 0.0)
    assert three.recall == 1.0 and three.completeness == 1.0
    assert three.ndcg == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3)))
    assert three.map == pytest.approx((1 + 2 / 3) / 2)
    assert (found["none", 3].recall, found["none", 3].mrr, found["none", 3].ndcg) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        ranking.query_metrics(ranked, relevant, [0])


def test_code_metrics_by_hand(spark):
    data = [(i, c, f"{c[0]}/{c[1]}") for i, c in enumerate([[0, 0], [0, 0], [1, 1], [1, 2]])]
    frame = spark.createDataFrame(data, "skill_id int, indices array<int>, path string")
    one = summaries.collision_metrics(frame).first()
    assert (one.collision_rate, one.max_bucket, one.colliding_rate) == (0.25, 2, 0.5)
    levels = {r.level: r for r in summaries.code_level_metrics(frame, [2, 3]).collect()}
    assert levels[1].utilization == 1.0 and levels[1].variation == 0.0 and levels[1].normalized_entropy == pytest.approx(1.0)
    assert levels[2].min_usage == 1 and levels[2].max_usage == 2


def test_quantiles_interpolate(spark):
    found = summaries.quantiles(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "n double"), "n").first()
    assert (found["min"], found["median"], found["p25"], found["max"]) == (1.0, 2.5, 1.75, 4.0)


def test_stable_hash_is_the_first_eight_bytes(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"7\x1fabc").digest()[:8], "big")
    assert int(spark.range(1).select(hashing.stable_hash(F.lit(7), F.lit("abc"))).first()[0]) == want


def test_text_functions(spark):
    one = spark.createDataFrame(
        [("# Head\n<b>Hi</b> [x](u) ![y](v) `z` &lt;q&gt; <!-- no -->\n```code```", "Use @own/slug now", "api_key: 'abc' and Bearer x.y", None)],
        "md string, t string, s string, n string",
    )
    r = one.select(
        text.cleaned_markup(F.col("md"), 100).alias("clean"),
        text.leaks_identifier(F.col("t")).alias("leak"),
        text.redacted(F.col("s"), ["abc"]).alias("red"),
        text.normalized(F.col("n")).alias("none"),
        F.size(text.char_grams(F.col("n"))).alias("grams"),
        text.char_grams(F.lit("ab")).alias("short"),
        text.duration_text(F.lit(90061.7)).alias("long"),
        text.duration_text(F.lit(-5)).alias("zero"),
        text.repaired_span(F.lit("take the red pill now"), F.lit("the...pill")).alias("span"),
        text.json_object(F.lit('x ```json\n[1, 2]\n``` y')).alias("json"),
        text.section(F.lit("## A: x\nlead\none\n## B\ntwo"), "A").alias("section"),
        text.front_matter(F.lit("---\nname: 'n'\nkind: k\n---\nbody")).alias("front"),
        text.sensitive_name(F.lit("apiKey")).alias("sensitive"),
    ).first()
    assert r.clean == "Head Hi x y z <q>"
    assert r.leak and r.none == "" and r.grams == 1 and r.short == ["ab"]
    assert "abc" not in r.red and "x.y" not in r.red
    assert (r.long, r.zero) == ("1d 1h 1m 1s", "0s")
    assert r.span == "the red pill" and r.json == '{"items":[1, 2]}'
    assert r.section.strip() == "lead\none" and r.front == {"name": "n", "kind": "k"} and r.sensitive


def test_vectors(spark):
    r = spark.range(1).select(
        vectors.norm(F.lit([3.0, 4.0])).alias("n"), vectors.unit(F.lit([0.0, 0.0])).alias("z"), vectors.fused(F.lit([3.0, 4.0]), F.lit([0.0, 2.0]), 0.36).alias("f"), vectors.log_sum_exp(F.lit([0.0, 0.0])).alias("l")
    ).first()
    assert r.n == 5.0 and r.z == [0.0, 0.0] and r.f == pytest.approx([0.48, 0.64, 0.0, 0.6]) and r.l == pytest.approx(math.log(2))


def test_grouped_split_leaks_no_group(spark):
    frame = spark.range(200).select((F.col("id") % 40).alias("g"), "id")
    found = splits.grouped_split(frame, "g", 0.1, 3)
    assert found.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert found.filter("split = 'validation'").select("g").distinct().count() == 4


def test_target_preserving_split_equals_the_sequential_rule(spark):
    import hashlib

    data = [(g, f"t{(g * k) % 23}") for g in range(60) for k in (1, 2, 5)]
    frame = spark.createDataFrame(data, "g int, t string")
    got = {r.g for r in splits.preserving_validation_groups(frame, "g", "t", 0.3, 9, 2).collect()}
    targets = {}
    for g, t in set(data):
        targets.setdefault(g, set()).add(t)
    left = {}
    for ts in targets.values():
        for t in ts:
            left[t] = left.get(t, 0) + 1
    want = []
    for g in sorted(targets, key=lambda g: (hashlib.sha256(f"9|{g}".encode()).hexdigest(), g)):
        if len(want) < 18 and all(left[t] - 1 >= 2 for t in targets[g]):
            want.append(g)
            for t in targets[g]:
                left[t] -= 1
    assert got == set(want)


def test_near_duplicates_equal_the_sequential_scan(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (5, 6), (1, 7)]
    frame = spark.createDataFrame([(i,) for i in range(1, 9)], "id int")
    found = splits.near_duplicates(spark.createDataFrame(pairs, "a int, b int"), frame, "id", [F.col("id")])
    assert {r.id for r in found.collect() if r.accepted} == {1, 3, 5, 8}


def test_banded_pairs_confirm_by_jaccard(spark):
    texts = [(1, "please book a table for two people tonight"), (2, "please book a table for two people tonight ok"), (3, "something else entirely")]
    frame = spark.createDataFrame(texts, "id int, text string").withColumn("grams", text.char_grams(F.col("text")))
    assert [(r.a, r.b) for r in similarity.banded_pairs(frame, 0.86).collect()] == [(1, 2)]


def test_replay_allocation():
    assert splits.replay_allocation(80, [("a", 0.15), ("b", 0.05)]) == {"a": 15, "b": 5}
    assert splits.replay_allocation(10, [("a", 0.0)]) == {"a": 0}


def test_replay_cycles_short_sources(spark):
    found = splits.replayed(spark.range(3).withColumnRenamed("id", "k"), "k", 8, 1)
    assert found.count() == 8
    assert sorted(r["count"] for r in found.groupBy("cycle").count().collect()) == [2, 3, 3]


def test_orders_are_rotations_first(spark):
    frame = spark.createDataFrame([("q", ["a", "b", "c"])], "id string, skill_ids array<string>")
    found = splits.augmented_orders(frame, 9, 1).orderBy("target_order_variant").collect()
    assert [r.skill_ids for r in found[:3]] == [["a", "b", "c"], ["b", "c", "a"], ["c", "a", "b"]]
    assert len({tuple(r.skill_ids) for r in found}) == 6 and [r.id for r in found[:2]] == ["q", "q--ord-1"]


@pytest.mark.parametrize(("targets", "variants"), [(5, 9), (5, 200), (6, 3), (7, 7), (1, 4)])
def test_orders_of_any_number_of_targets(spark, targets, variants):
    items = [chr(97 + i) for i in range(targets)]
    frame = spark.createDataFrame([("q", items), ("none", [])], "id string, skill_ids array<string>")
    found = [tuple(r.skill_ids) for r in splits.augmented_orders(frame, variants, 3).orderBy("target_order_variant").collect()]
    turned = [tuple(items[i:] + items[:i]) for i in range(targets)]
    rest = sorted(set(itertools.permutations(items)) - set(turned), key=lambda p: int.from_bytes(hashlib.sha256("\x1f".join(["3", "q", *p]).encode()).digest()[:8], "big"))
    assert found == (turned + rest)[:variants]


def test_single_target_pass_needs_every_score_and_flag(spark):
    good = {"style": 3, "relevance": 4, "specificity": 3, "coherence": 4}
    flags = {"satisfied": True, "missing": False, "extra": False, "unsafe": False}
    cases = [(good, flags, True), ({**good, "style": None}, flags, False), (good, {**flags, "missing": None}, True), (good, {**flags, "satisfied": None}, False)]
    cases += [({**good, k: v - 1}, flags, False) for k, v in good.items()] + [(good, {**flags, k: not v}, False) for k, v in flags.items()]
    frame = spark.createDataFrame([(s, *f.values(), w) for s, f, w in cases], "s map<string,int>, a boolean, b boolean, c boolean, d boolean, want boolean")
    got = frame.select(validation.single_target_pass(F.col("s"), *(F.col(c) for c in "abcd")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_best_matches_equal_the_greedy_order(spark):
    left = [(i, i % 3, float(i * 37 % 19)) for i in range(70)] + [(100 + i, 9, 1.0) for i in range(60)]
    right = [(i, i % 3, float(i * 53 % 23)) for i in range(60)] + [(100 + i, 9, 1.0) for i in range(60)]  # all of block 9 are tied
    a, b = spark.createDataFrame(left, "l int, block int, x double"), spark.createDataFrame(right, "r int, block int, y double")
    found, again = ({(r.l, r.r) for r in joins.best_matches(a, b, "block", -F.abs(F.col("x") - F.col("y")), -6.0, at_once=k).collect()} for k in (50_000, 700))
    pairs = sorted((abs(x - y), i, j) for i, p, x in left for j, q, y in right if p == q and abs(x - y) <= 6)
    used, wanted = set(), set()
    for _, i, j in pairs:
        if ("l", i) not in used and ("r", j) not in used:
            used |= {("l", i), ("r", j)}
            wanted.add((i, j))
    assert found == again == wanted


def test_confusable_equals_brute_force(spark):
    profiles = [(i, i * 7 % 5, [None, "x", "y"][i % 3], [["p"], ["p", "q"], [], ["r", "q", "q"]][i % 4], [[], ["f", "g"], ["g"], ["h", "f", "f"], ["z"]][i * i % 5]) for i in range(60)]
    frame = spark.createDataFrame(profiles, "skill_id int, rank int, domain string, roles array<string>, features array<string>")
    found = {(r.skill_id, r.position): (r.confusable_id, r.score) for r in joins.confusable(frame).collect()}
    wanted = {}
    for i, _, d, roles, f in profiles:
        near = []
        for j, rank, e, others, g in profiles:
            if i != j and ((d is not None and d == e) or set(roles) & set(others)):
                jac = len(set(f) & set(g)) / len(set(f) | set(g)) if f and g else 0.0
                near.append((-round(jac + 0.08 * (d is not None and d == e) + 0.02 * len(set(roles) & set(others)), 9), rank, -j))
        wanted |= {(i, k): (-b, -s) for k, (s, _, b) in enumerate(sorted(near)[:3], 1)}
    assert found == wanted


def test_grams_of_a_long_text_are_linear(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(1_000_000))
    frame = spark.createDataFrame([(long,)], "t string")
    began = time.perf_counter()
    assert frame.select(F.size(text.char_grams(F.col("t")))).first()[0] == len({long[i : i + 3] for i in range(len(long) - 2)})
    assert time.perf_counter() - began < 20


def test_assignment_is_balanced_and_stable(spark):
    costs = spark.createDataFrame([(s, c, float((s * 7 + c * 5) % 11)) for s in range(10) for c in range(3)], "sample int, code int, cost double")
    caps = codes.balanced_capacities(spark.createDataFrame([(1, 8), (0, 2)], "code int, n int"), 3, 10)
    assert rows(caps, "code") == [(0, 3), (1, 4), (2, 3)]
    found = {r.sample: r.code for r in codes.deferred_assignment(costs, caps).collect()}
    assert len(found) == 10 and sorted(list(found.values()).count(c) for c in range(3)) == [3, 3, 4]
    cost = {(r.sample, r.code): r.cost for r in costs.collect()}
    for s, c in found.items():  # no sample and code would both rather have each other
        for other in range(3):
            if (cost[s, other], other) < (cost[s, c], c):
                assert all((cost[x, other], x) < (cost[s, other], s) for x, y in found.items() if y == other)


def test_sinkhorn_rows_and_columns(spark):
    costs = spark.createDataFrame([(s, c, abs(s - 2.0 * c)) for s in range(6) for c in range(3)], "sample int, code int, cost double")
    plan = codes.sinkhorn(costs, 1.0, 30)
    assert all(r[1] == pytest.approx(2.0, abs=1e-6) for r in plan.groupBy("code").agg(F.sum("plan")).collect())
    rounded = codes.round_plan(plan)
    assert sorted(r["count"] for r in rounded.groupBy("code").count().collect()) == [2, 2, 2]


def test_residual_codes_and_beam_agree(spark):
    frame = spark.createDataFrame([(i, [math.sin(i * j + 1) for j in range(4)]) for i in range(30)], "vec_id int, embedding array<double>")
    books = codes.seeded_codebooks(frame, [4, 3])
    near = {r.vec_id: r.indices for r in codes.residual_codes(frame, books).collect()}
    beam = {r.vec_id: r.indices for r in codes.beam_paths(frame, books, 1).collect()}
    assert near == beam
    balanced = codes.balanced_hierarchical_codes(frame, books)
    usage = [r["count"] for r in balanced.groupBy(F.col("indices")[0]).count().collect()]
    assert sorted(usage) == [7, 7, 8, 8]


def test_taxonomy_append_and_overflow(spark):
    known = spark.createDataFrame([("", "a", 0), ("", "b", 1)], "prefix string, label string, slot int")
    placed, over = codes.appended_slots(known, spark.createDataFrame([("", "d"), ("", "c"), ("", "a")], "prefix string, label string"), 3)
    assert rows(placed, "label") == [("", "c", 2)] and rows(over, "label") == [("", "d", 3)]


def test_prefix_table_and_grammar(spark):
    paths = spark.createDataFrame([(["0", "0"],), (["0", "1"],), (["1", "0"],)], "tokens array<string>")
    found = {tuple(r.prefix): r.allowed for r in decoding.prefix_table(paths).collect()}
    assert found == {(): ["0", "1"], ("0",): ["0", "1"], ("1",): ["0"]}
    texts = spark.createDataFrame([(1, "a <sep> b"), (2, "a <sep> a"), (3, "a <sep> z")], "q int, text string")
    known = spark.createDataFrame([("a",), ("b",)], "path string")
    assert rows(decoding.parsed_sequences(texts, known, "q", 2), "q") == [(1, 2, True), (2, 2, False), (3, 2, False)]


def test_bucket_candidates_keep_the_best(spark):
    paths = spark.createDataFrame([("q", 1, "x", 0.5), ("q", 2, "y", 0.9)], "query_id string, path_rank int, path string, score double")
    buckets = spark.createDataFrame([("x", ["s1", "s2"]), ("y", ["s2", "s3"])], "path string, skills array<string>")
    found = ranking.bucket_candidates(paths, buckets, 3).orderBy("position").collect()
    assert [(r.skill_id, r.score) for r in found] == [("s1", 0.5), ("s2", 0.9), ("s3", 0.9)]


def test_metric_points_carry_state(spark):
    lines = ["[05] memorization", "10/100", "{'loss': 2.5, 'epoch': 0.1}", "{'loss': 2.5, 'epoch': 0.1}", "\x1b[31m[06a]\x1b[0m go", "{'eval_loss': 2.1}", "{'loss': nan}"]
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run string, line_no int, line string")
    found = logs.metric_points(log).orderBy("sequence").collect()
    assert [(r.phase, r.kind, r.loss, r.step) for r in found] == [("memorization", "train", 2.5, 10), ("alignment", "eval", 2.1, None)]


def test_thinning_keeps_the_ends(spark):
    points = spark.range(1, 101).select(F.lit("r").alias("run"), F.col("id").alias("sequence"))
    found = [r.sequence for r in logs.thinned(points, ["run"], ["sequence"], 7).orderBy("sequence").collect()]
    assert found == sorted({1 + min(99, round(i * 99 / 6)) for i in range(7)})
    assert [r.sequence for r in logs.thinned(points, ["run"], ["sequence"], 1).collect()] == [100]


def test_overlay_folds_to_the_last_operation(spark):
    ops = spark.createDataFrame([("a", 1, "add", "x"), ("a", 2, "remove", "x"), ("b", 1, "add", "y"), ("b", 3, "add", "z")], "k string, rev int, op string, v string")
    assert rows(logs.folded(ops, "k", "rev"), "k") == [("b", 3, "z")]


def test_gpu_lines(spark):
    gpus = spark.createDataFrame([("0, u0, A, 10, 80",), ("bad",), ("1, u1, B, 0, 80",)], "line string")
    procs = spark.createDataFrame([("u0, 42, 7",), ("ux, 1, 1",)], "line string")
    found = logs.gpu_metrics(gpus, procs).orderBy("index").collect()
    assert [(r["index"], [p.pid for p in r.processes]) for r in found] == [(0, [42]), (1, [])]


def test_violations_and_gate(spark):
    skills = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    queries = spark.createDataFrame([("q1", "x", ["a", "b"]), ("q2", " ", ["z"])], "query_id string, query string, skill_ids array<string>")
    qrels = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "z")], "query_id string, skill_id string")
    held = spark.createDataFrame([("q1",)], "query_id string")
    found = validation.dataset_violations(skills, queries, qrels, held)
    assert {r.rule for r in found.collect()} == {"blank query", "unknown target", "unknown judged skill", "query in two splits"}
    with pytest.raises(validation.ValidationError, match="blank query"):
        validation.require_valid(found)
    validation.require_valid(found.limit(0))


def test_greedy_matches_are_one_to_one(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "l int, block string")
    b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "r int, block string")
    found = joins.best_matches(a, b, "block", -F.abs(F.col("l") - F.col("r")).cast("double"), -5.0)
    assert sorted((r.l, r.r) for r in found.collect()) == [(1, 1), (2, 2)]


def test_best_matches_of_more_rounds_than_fifty(spark):
    a = spark.createDataFrame([(i, 0) for i in range(52)], "l int, block int")
    found = joins.best_matches(a, a.withColumnRenamed("l", "r"), "block", F.lit(1.0), 0.5)
    assert sorted((r.l, r.r) for r in found.collect()) == [(i, i) for i in range(52)]


def test_encoded_examples(spark):
    frame = spark.createDataFrame([(1, ["p1", "p2", "p3"], ["t"])], "id int, prompt array<string>, target array<string>")
    r = documents.encoded_examples(frame, 3).first()
    assert r.tokens == ["p1", "p2", "t"] and r.labels == ["-100", "-100", "t"]
    with pytest.raises(Exception, match="longer than the limit"):
        documents.encoded_examples(frame, 0).collect()


def test_broken_inputs_give_empty_results(spark):
    qrels = spark.createDataFrame([], "query_id long, skill_id long, ord int")
    assert graphs.couse_edges(qrels).count() == 0
    assert ranking.query_metrics(qrels.select("query_id", F.col("ord").alias("rank"), "skill_id"), qrels, [1]).count() == 0
    assert summaries.collision_metrics(spark.createDataFrame([], "skill_id long, path string")).first().collision_rate == 0.0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert DATA


def _profiles(spark):
    from routeloom.operators.workflows import DOMAIN_NEIGHBORS, ROLE_ORDER

    domains, roles = sorted(DOMAIN_NEIGHBORS), sorted(ROLE_ORDER)
    data = [(f"s{i:02}", i, domains[i % 7], [roles[i % 13], roles[(i * 5) % 13]], [f"f{i}", f"f{i % 9}"], ["low", "high"][i % 2]) for i in range(40)]
    return spark.createDataFrame(data, "skill_id string, rank int, domain string, roles array<string>, features array<string>, mobile_fit string")


def test_workflows_cover_every_anchor_without_repeats(spark):
    from routeloom.operators import workflows

    found = workflows.built_workflows(_profiles(spark), 4, 7).collect()
    assert len(found) == 160 and len({r.workflow_id for r in found}) == 160
    assert len({frozenset(r.skill_ids) for r in found}) > 150  # a set repeats only where no other is left
    assert all(r.anchor_skill_id in r.skill_ids and len(set(r.skill_ids)) == [2, 3, 4, 3][r.anchor_round] for r in found)
    with pytest.raises(ValueError, match="more than"):
        workflows.built_workflows(_profiles(spark), 4, 7, most=10)


def test_recovery_rules(spark):
    from routeloom.operators import workflows

    specs = spark.createDataFrame([(1, "s01", ["s02", "s02"]), (2, "s02", ["s01"]), (3, "s03", []), (4, "s04", ["zz"])], "spec int, anchor_skill_id string, collaborator_skill_ids array<string>")
    good, bad = workflows.recovered_workflows(specs, _profiles(spark))
    assert [(r.anchor_skill_id, sorted(r.skill_ids)) for r in good.collect()] == [("s01", ["s01", "s02"])]
    assert rows(bad, "spec") == [(2, "set twice"), (3, "number of skills"), (4, "unknown skill")]


def test_queries_payloads_and_export(spark):
    from routeloom.operators import workflows

    queries = spark.createDataFrame([("q1", "t", ["b", "x", "a", "b"]), ("q2", None, ["x"]), (" ", "t", ["a"])], "query_id string, query string, skill_ids array<string>")
    catalog = spark.createDataFrame([("a",), ("b",)], "skill_id string")
    assert [tuple(r) for r in workflows.normalized_queries(queries, catalog).collect()] == [("q1", "t", ["b", "a"], 2)]
    body = '```json\n{"items": [{"workflow_id": "w1", "variants": [{"query": "x"}, {"query": "y"}]}, {"workflow_id": "w2", "variants": [{"query": "z"}]}, {"workflow_id": "w9", "variants": []}]}\n```'
    responses = spark.createDataFrame([(1, body)], "batch int, body string")
    asked = spark.createDataFrame([(1, "w1"), (1, "w2"), (1, "w3")], "batch int, workflow_id string")
    good, bad = workflows.parsed_payloads(responses, asked, 2)
    assert rows(good, "variant") == [("w1", 0, "x"), ("w1", 1, "y")]
    assert rows(bad, "workflow_id") == [("w2", "variant count"), ("w3", "missing"), ("w9", "not requested")]
    reviews = spark.createDataFrame([("q1", True)], "query_id string, pass boolean")
    out = workflows.exported(queries.withColumn("workflow_id", F.lit("w")), reviews, F.lit("train"))
    assert workflows.manifest(out) == '{"train": {"rows": 1, "workflows": 1, "targets": 4.0}}'
    assert [r.skill_id for r in workflows.coverage_failures(out, spark.createDataFrame([("a",), ("c",)], "skill_id string"), 1).collect()] == ["c"]
    gold = spark.createDataFrame([("q1", "a"), ("q1", "b")], "query_id string, skill_id string")
    counts = spark.createDataFrame([("a", 4)], "skill_id string, n int")
    assert rows(workflows.recall_by_frequency(gold.filter("skill_id = 'a'"), gold, counts), "bin") == [("0", 1, 0.0), ("3-5", 1, 1.0)]


def test_strategies_keep_codes_and_roll_back(spark, tmp_path):
    from routeloom.operators import strategies

    skills = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "y", "1")], "skill_id string, l1 string, l2 string")
    s = strategies.create("taxonomy", labels=["l1", "l2"], limit=3).fit(skills)
    before = {r.skill_id: r.indices for r in s.members.collect()}
    assert before == {"a": [0, 0], "b": [0, 1], "c": [1, 0]}
    s.add(spark.createDataFrame([("d", "x", "0")], "skill_id string, l1 string, l2 string"))
    after = {r.skill_id: r.indices for r in s.members.collect()}
    assert after == before | {"d": [0, 2]}
    with pytest.raises(ValueError, match="no slot"):
        s.add(spark.createDataFrame([("e", "x", "9")], "skill_id string, l1 string, l2 string"))
    assert {r.skill_id: r.indices for r in s.members.collect()} == after
    s.remove(spark.createDataFrame([("a",)], "skill_id string"))
    assert sorted(r.skill_id for r in s.decode([0]).collect()) == ["b", "d"]
    s.save(str(tmp_path / "s"))
    again = strategies.load(spark, str(tmp_path / "s"))
    assert again.state() == s.state() and again.members.count() == 3 and again.next_tokens().count() == s.next_tokens().count()
    vectors_ = spark.createDataFrame([(f"v{i}", [math.sin(i), math.cos(i * 3)]) for i in range(12)], "skill_id string, vector array<double>")
    b = strategies.create("balanced", sizes=[3], iterations=3).fit(vectors_)
    assert sorted(r["count"] for r in b.members.groupBy("indices").count().collect()) == [4, 4, 4]
    with pytest.raises(ValueError, match="unknown"):
        strategies.create("other")


def test_ranked_in_is_a_binary_search(spark):
    import bisect
    import random

    from routeloom.functions.expressions import ranked_in

    r = random.Random(1)
    lists = [(sorted(r.randrange(-50, 50) for _ in range(n)),) for n in (0, 1, 2, 3, 4, 5, 8, 31, 32, 33, 100)] + [(None,)]
    values = list(range(-60, 60, 3))
    found = spark.createDataFrame(lists, "a array<bigint>").select("a", ranked_in(F.col("a"), lambda f: F.transform(F.lit(values), lambda v: f(v.cast("long")))).alias("p"))
    assert all(x.p == [bisect.bisect_right(x.a or [], v) for v in values] for x in found.collect())


def test_grouped_assignment_has_the_least_cost(spark):
    import random

    r = random.Random(2)
    data, best = [], {}
    for g, (n, m) in enumerate([(1, 1), (1, 4), (3, 3), (3, 5), (4, 2), (5, 3), (6, 4), (7, 3), (2, 2)]):
        cost = [[r.choice([0.0, 1.0, -2.0, r.random() * 9]) for _ in range(m)] for _ in range(n)]
        data += [(g, s, c, cost[s][c]) for s in range(n) for c in range(m)]
        share = [1] * m
        if n > m:
            near = [min(range(m), key=lambda c: (row[c], c)) for row in cost]
            more = sorted(range(m), key=lambda c: (-near.count(c), c))[: n % m]
            share = [n // m + (c in more) for c in range(m)]
        fits = (x for x in itertools.product(range(m), repeat=n) if all(x.count(c) <= share[c] for c in range(m)))
        best[g] = (min(sum(cost[s][c] for s, c in enumerate(x)) for x in fits), n, share)
    frame = spark.createDataFrame(data, "group int, sample int, code int, cost double")
    found = codes.grouped_assignment(frame).join(frame, ["group", "sample", "code"]).collect()
    for g, (total, n, share) in best.items():
        own = [x for x in found if x.group == g]
        assert len(own) == n and sum(x.cost for x in own) == pytest.approx(total)
        assert all([x.code for x in own].count(c) <= share[c] for c in range(len(share)))


def test_bucket_candidates_equal_full_expansion(spark):
    """Ranks with and without falling scores, ties, null scores and skills in several buckets."""
    import random

    r = random.Random(5)
    buckets = {p: sorted(r.sample(range(12), r.choice([1, 2, 4, 7]))) for p in "abcdef"}
    data, wanted = [], {}
    for q in range(60):
        chosen = r.sample("abcdefz", r.randint(1, 5))
        scores = [r.choice([None, 0.1, 0.5, 0.5, 0.9]) for _ in chosen]
        if q % 2:
            scores.sort(key=lambda s: (s is None, -(s or 0)))
        data += [(q, k, p, s) for k, (p, s) in enumerate(zip(chosen, scores, strict=True), 1)]
        best = {}
        for k, (p, s) in enumerate(zip(chosen, scores, strict=True), 1):
            for x in buckets.get(p, []):
                best[x] = min(best.get(x, (2, 0, 0, None)), (s is None, -(s or 0), k, s), key=lambda b: b[:3])
        order = sorted(best, key=lambda x: (best[x][2], x))[:3]
        wanted |= {(q, n): (x, best[x][3], best[x][2]) for n, x in enumerate(order, 1)}
    paths = spark.createDataFrame(data, "query_id int, path_rank int, path string, score double")
    frame = spark.createDataFrame([(p, x[::-1]) for p, x in buckets.items()], "path string, skills array<int>")
    found = {(x.query_id, x.position): (x.skill_id, x.score, x.path_rank) for x in ranking.bucket_candidates(paths, frame, 3).collect()}
    assert found == wanted


def test_bucket_candidates_of_large_buckets_are_not_expanded_whole(spark):
    buckets = spark.range(200_000).groupBy((F.col("id") % 4).cast("string").alias("path")).agg(F.collect_set("id").alias("skills"))
    paths = spark.range(6000).select(F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("path_rank"))
    paths = paths.withColumn("path", F.col("path_rank").cast("string")).withColumn("score", -F.col("path_rank").cast("double"))
    began = time.perf_counter()
    found = ranking.bucket_candidates(paths, buckets, 8)
    assert found.agg(F.count(F.lit(1)), F.max("skill_id"), F.max("path_rank")).first()[:] == (48_000, 28, 0)
    assert time.perf_counter() - began < 30


def test_path_metrics_equal_plain_counting(spark):
    """Skills in several buckets, judgements that repeat, paths without a bucket, queries without a prediction."""
    import random

    r = random.Random(6)
    buckets = {p: r.sample(range(10), r.choice([1, 2, 4, 7])) for p in "abcdef"}
    gold = {q: [(r.randrange(10), r.choice("abcdefz"), r.randrange(4)) for _ in range(r.randint(1, 6))] for q in range(60)}
    predicted = {q: r.sample("abcdefz", r.randint(0, 5)) for q in range(70) if q % 7}
    wanted = {}
    for q, judged in gold.items():
        firsts = {p: min(o for _, x, o in judged if x == p) for _, p, _ in judged}
        paths, skills, own = sorted(firsts, key=lambda p: (firsts[p], p)), {s for s, _, _ in judged}, predicted.get(q, [])
        for k in (1, 3):
            found = len(skills & {s for p in own[:k] for s in buckets.get(p, [])}) / len(skills)
            recall = len(set(paths) & set(own[:k])) / len(paths)
            wanted[q, k] = (recall, found, float(found == 1), float(own == paths), float(len(own) == len(paths)), float(abs(len(own) - len(paths))))
    frame = spark.createDataFrame([(q, *x) for q, judged in gold.items() for x in judged * 2], "query_id int, skill_id int, path string, ord int")
    pred = spark.createDataFrame(list(predicted.items()), "query_id int, paths array<string>")
    found = ranking.path_metrics(pred, frame, [1, 3], spark.createDataFrame(list(buckets.items()), "path string, skills array<int>")).collect()
    assert {(x.query_id, x.k): tuple(x)[2:] for x in found} == wanted and len(found) == len(wanted)


def test_path_metrics_of_large_buckets_do_not_expand_them(spark):
    buckets = spark.range(200_000).groupBy((F.col("id") % 4).cast("string").alias("path")).agg(F.collect_set("id").alias("skills"))
    pred = spark.range(6000).select(F.col("id").alias("query_id"), F.array(*map(F.lit, "0123")).alias("paths"))
    gold = spark.range(6000).select(F.col("id").alias("query_id"), F.col("id").alias("skill_id"), (F.col("id") % 4).cast("string").alias("path"), F.lit(1).alias("ord"))
    began = time.perf_counter()
    found = ranking.path_metrics(pred, gold, [1, 3], buckets).groupBy("k").agg(F.avg("bucket_recall")).collect()
    assert {x.k: x[1] for x in found} == {1: 0.25, 3: 0.75}
    assert time.perf_counter() - began < 30


def test_grouped_assignment_of_large_groups_has_the_least_cost(spark):
    import numpy as np

    r = np.random.default_rng(3)
    for n, m, draw in [(200, 7, r.random), (150, 3, lambda x: r.integers(0, 3, x).astype(float)), (90, 40, r.random), (30, 1, r.random)]:
        cost, shares = draw((n, m)), n // m + (np.arange(m) < n % m)
        slots = np.repeat(np.arange(m), shares)
        square, few = slots[codes.least_cost_assignment(cost[:, slots])], codes.least_cost_shares(cost, shares)
        assert (np.bincount(few, minlength=m) == shares).all()
        assert cost[np.arange(n), few].sum() == pytest.approx(cost[np.arange(n), square].sum())
    # a group of 301: codes far from most samples are filled by those that lose least
    data = [(0, s, c, abs(s / 10 - 15.0 * c)) for s in range(301) for c in range(3)]
    frame = spark.createDataFrame(data, "group int, sample int, code int, cost double")
    found = {x.sample: x.code for x in codes.grouped_assignment(frame).collect()}
    assert len(found) == 301 and sorted([*found.values()].count(c) for c in range(3)) == [100, 100, 101]
    assert [found[s] for s in range(301)] == sorted(found.values())
