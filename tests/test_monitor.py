"""Host alerts, retention sweeps, fix budgets, circular means, dominance and tag joins against plain Python."""

import json
import math
import random

from pyspark.sql import functions as F

from hearthspan.operators import market, monitor, valuation, vectors

HOSTS = "host string, site long, role int, age_s long, budget_s long, was_down boolean, reachable boolean"


def alerts(spark, ages, down=(), reachable=True):
    watched = [("lead", 0, 600), ("watch", 1, 600), ("far", 2, 900), ("box", 2, 900)]
    rows = [(h, 1, role, ages.get(h), budget, h in down, reachable) for h, role, budget in watched]
    return {tuple(r) for r in monitor.host_alerts(spark.createDataFrame(rows, HOSTS)).collect()}


FRESH = {"lead": 30, "watch": 30, "far": 30, "box": 30}


def test_host_alerts(spark):
    assert alerts(spark, FRESH) == set()
    assert alerts(spark, FRESH | {"far": 2000}) == {("far", "down")} and alerts(spark, FRESH | {"far": 2000}, {"far"}) == set()
    assert alerts(spark, FRESH | {"far": 700}) == set()  # inside its own budget
    assert alerts(spark, FRESH, {"far"}) == {("far", "up")}
    assert alerts(spark, {k: v for k, v in FRESH.items() if k != "watch"}) == {("watch", "down")}
    # the lead's alert stands for the host it replaces, which does not recover meanwhile either
    dark = FRESH | {"lead": 2000, "watch": 2000}
    assert alerts(spark, dark) == {("lead", "down")} and alerts(spark, dark, {"watch"}) == {("lead", "down")}
    # what cannot be read is unknown, not down, and stays as it was
    assert alerts(spark, {}, (), False) == {("lead", "down")} and alerts(spark, {}, {"lead"}, False) == set()
    assert alerts(spark, FRESH, {"far"}, False) == {("lead", "down")}


def test_sweeps(spark):
    docs = spark.createDataFrame([("a", v) for v in ["v1", "v2", "v2"]] + [("b", "v1"), ("b", "v1"), ("b", "v2")], "table_name string, data_version string")
    assert {(r.table_name, r.refused, r.delete_n) for r in monitor.version_sweep(docs, "v2").collect()} == {("a", 0, 1), ("b", 1, 0)}
    rows = spark.createDataFrame([("often", t) for t in range(10)] + [("rare", 1)], "table_name string, at_s long")
    assert {(r.table_name, r.delete_n) for r in monitor.age_sweep(rows, 4).collect()} == {("often", 4), ("rare", 1)}
    assert {(r.table_name, r.delete_n) for r in monitor.frequent_sweep(rows, 4, 5).collect()} == {("often", 4), ("rare", 0)}
    left = spark.createDataFrame([("m", 1), ("m", 2), ("m", None)], "table_name string, parent long")
    assert [tuple(r) for r in monitor.orphan_sweep(left, spark.createDataFrame([(1,), (1,)], "parent long")).collect()] == [("m", 3, 2, 0, 2)]
    held = {r.table_name: (r.kept, r.holds) for r in monitor.window_holds(rows, rows.where("at_s >= 4"), 4).collect()}
    assert held == {"often": (6, 1), "rare": (0, 1)}
    assert {r.table_name: r.holds for r in monitor.window_holds(rows, rows.where("at_s >= 5"), 4).collect()}["often"] == 0


def test_fixes_alone_spend_the_budget(spark):
    acts = [(1, 0, "detect", True), (2, 10, "fix", True), (3, 20, "detect", True), (4, 30, "escalate", True), (5, 40, "detect", True), (6, 50, "recover", False), (7, 60, "detect", True), (8, 500, "detect", True)]
    df = spark.createDataFrame([(n, "r", "t", at, a, f) for n, at, a, f in acts], "run_id long, rule_id string, target string, at_s long, action string, faulty boolean")
    got = {r.run_id: (r.in_window, r.open_problem, r.verdict) for r in monitor.fix_budget(df, 100, 1).collect()}
    assert got == {1: (0, None, "fix"), 2: (0, "detect", "fix"), 3: (1, "fix", "escalate"), 4: (1, "detect", "escalate"), 5: (1, "escalate", "wait"), 7: (1, None, "escalate"), 8: (0, "detect", "fix")}


def test_circular_mean_needs_one_arc(spark):
    rng = random.Random(4)
    sets = {0: [359.5, 3.2, 0.0], 1: [10.0, 24.9], 2: [10.0, 25.1], 3: [rng.random() for _ in range(3000)], 4: [0.0, 120.0, 240.0], 5: [352.0, 352.0], 6: [-5.0, 4.0]}
    df = spark.createDataFrame([(k, float(a)) for k, own in sets.items() for a in own] + [(7, None)], "k long, a double")
    got = {r.k: r for r in monitor.circular_combine(df, "k", "a").collect()}
    for k, own in sets.items():
        wide = max(min(abs(a - b) % 360, 360 - abs(a - b) % 360) for a in own[:60] + own[-1:] for b in own[:60])
        assert got[k].n == len(own) and got[k].emitted == int(wide <= 15)
        if wide <= 15:
            mean = math.degrees(math.atan2(sum(math.sin(math.radians(a)) for a in own), sum(math.cos(math.radians(a)) for a in own))) % 360
            assert min(abs(got[k].mean - mean), 360 - abs(got[k].mean - mean)) < 1e-6
    assert 7 not in got


def test_dominated_counts(spark):
    rng = random.Random(5)
    stock = [(rng.choice("ab"), rng.choice([None, *range(0, 900, 7)]), rng.choice([None, 1, 2, 3])) for _ in range(600)]
    calls = [(n, rng.choice("abc"), rng.randrange(-5, 950), rng.randrange(0, 5)) for n in range(80)]
    got = dict(map(tuple, market.dominated_counts(spark.createDataFrame(calls, "call_id long, outcode string, price_max long, beds_min long"), spark.createDataFrame(stock, "outcode string, asking_price long, bedrooms long")).collect()))
    assert got == {n: sum(o == out and p is not None and b is not None and p <= top and b >= beds for o, p, b in stock) for n, out, top, beds in calls}


def test_tag_supersets_start_from_the_rarest_tag(spark):
    rng = random.Random(6)
    anchors = [(n, rng.sample("xyz", rng.randrange(1, 4)) + (["rare"] if n % 40 == 0 else []) + ["all", "all"]) for n in range(200)]
    needs = [(1, ["all", "rare"]), (1, ["x", "x", "y"]), (2, ["none", "all"]), (3, ["all"]), (4, []), (5, ["y", "x"])]
    got = {tuple(r) for r in market.tag_supersets(spark.createDataFrame(needs, "query long, req array<string>"), spark.createDataFrame(anchors, "anchor long, tags array<string>")).collect()}
    assert got == {(q, a) for q, req in needs if req for a, tags in anchors if set(req) <= set(tags)}


def test_neighbour_prices_grow_to_the_day_asked_for(spark):
    n = spark.createDataFrame([(1, "p", 10.0, r, 1.0, 1000.0, 100.0, d) for r, d in enumerate(["2020-01-01"] * 6, 1)] + [(2, "q", 10.0, 1, 1.0, 1000.0, 100.0, "2020-01-01")] + [(3, "z", 10.0, r, 1.0, 1000.0, 100.0, "2020-01-01") for r in range(1, 7)],
                              "subject long, place string, area double, rank int, km double, c_price double, c_area double, c_date string").withColumn("c_date", F.to_date("c_date"))
    rates = spark.createDataFrame([("p", 10.0), ("q", 10.0), ("z", None)], "place string, rate double")
    got = {r.subject: tuple(r)[1:] for r in valuation.knn_estimate(n, rates, F.lit("2022-01-01").cast("date")).collect()}
    grown = math.floor(10 * 1.1 ** (731 / 365.25) * 10)
    assert got == {1: (6, grown, grown, grown), 2: (1, None, None, None), 3: (6, 100, 100, 100)}


def test_projection_keeps_the_variance_it_must(spark):
    rng = random.Random(7)
    axes = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)]
    rows = [(n, [sum(s * a[j] for s, a in zip((rng.gauss(0, 10), rng.gauss(0, 4), rng.gauss(0, 0.5)), axes)) + 100.0 for j in range(4)]) for n in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    two = vectors.project(df, 0.95).collect()
    assert {(r.components, r.passes) for r in two} == {(2, 1)} and 0.95 <= two[0].explained < 1
    assert {(r.components, r.passes) for r in vectors.project(df, 0.95, most=1).collect()} == {(1, 0)}
    mean = [sum(v[j] for _, v in rows) / len(rows) for j in range(4)]
    full = {r.vec_id: r.projected for r in vectors.project(df, 1.0).collect()}
    for n, v in rows[:20]:
        assert abs(sum((a - m) ** 2 for a, m in zip(v, mean)) - sum(x * x for x in full[n])) < 1e-6
    assert vectors.project(df.where("false")).count() == 0


def test_critic_summary_tells_every_verdict_and_every_issue(spark):
    issue = lambda severity, category, detail: {"severity": severity, "category": category} | ({"detail": detail} if detail else {})
    rows = [("a", "pass", [], None, "2026-05-10T08:00", False), ("a", "needs_revision", [issue("high", "tool_hallucination", "made up score"), issue("low", "format", None), issue("low", "tone", "curt")], None, "2026-05-11", True),
            ("a", "needs_revision", [issue("low", "incomplete", "critic output was unparseable: x")], None, "", False), ("a", None, [issue("high", "format", "empty")], "empty response from model", None, False),
            (None, "major", [issue("medium", "general_hallucination", "x"), issue(None, "off_domain_answered", "y")], "critic call failed: timeout", None, False)]
    df = spark.createDataFrame([(f, v, json.dumps(i), e, at, hit) for f, v, i, e, at, hit in rows], "source_file string, verdict string, issues string, error string, scored_at string, cached boolean")
    got = {r.source_file: r.asDict() for r in monitor.critic_summary(df, ["source_file"], "score").collect()}
    assert got["a"] == {"source_file": "a", "cases": 4, "passed": 1, "parse_failures": 1, "call_failures": 0, "empty_answers": 1, "sev_high": 2, "sev_medium": 0, "sev_low": 2, "tool_hallucination": 1, "general_hallucination": 0,
                        "missing_hedge": 0, "off_domain_answered": 0, "format": 2, "incomplete": 0, "cases_with_high": 2, "cases_with_tool_hallucination": 1, "tool_hallucination_matching": 1, "scored_from": "2026-05-10",
                        "scored_to": "2026-05-11", "cache_hits": 1, "pass_rate": 0.25, "pass_rate_judged": 0.333333, "verdicts": "? 1; needs_revision 2; pass 1", "issues": "high format 1; high tool_hallucination 1; low format 1; low tone 1"}
    none = got[None]
    assert (none["verdicts"], none["issues"], none["sev_medium"], none["call_failures"], none["pass_rate_judged"]) == ("major 1", "? off_domain_answered 1; medium general_hallucination 1", 1, 1, None)


def test_trace_compares_the_arguments_of_every_call(spark):
    runs = [(1, '[{"tool": "search", "args": {"kind": "House", "beds": 3, "new": true}}, {"tool": "search", "args": {"kind": "flat", "beds": "3"}}, {"tool": "score"}]', ["boom"], False, 28), (2, '[{"tool": "search", "args": {"kind": null, "beds": 3.0}}]', [], True, 0)]
    calls = spark.createDataFrame([(n, "c", doc, 10, e, d, rc) for n, doc, e, d, rc in runs], "run int, case string, doc string, answer_chars int, errors array<string>, done boolean, rc int").withColumn("calls", F.from_json("doc", "array<struct<tool:string,args:map<string,variant>>>"))
    calls = calls.withColumn("tools", F.transform("calls", lambda c: c["tool"]))
    checks = [("search", "kind", "in", '["house", null]'), ("search", "beds", "equals", "3"), ("search", "beds", "not_equals", '"3"'), ("search", "beds", "gte", "4"), ("search", "beds", "lte", "3"), ("search", "new", "equals", "1"), ("score", "x", "equals", "null"), ("score", "x", "lte", "1"), ("none", "x", "equals", "1")]
    cases = spark.createDataFrame([("c", ["score"], None, None, 5, checks, True)], "case string, need_all array<string>, need_any array<string>, never array<string>, min_chars int, checks array<struct<tool:string,arg:string,op:string,value:string>>, no_error boolean")
    got = {r.run: r.failures for r in monitor.trace_failures(calls, cases).collect()}
    assert got[1] == sorted(['errors boom', 'not done', 'rc 28', 'search.kind="flat" not in ["house",null]', 'search.beds="3" != 3', 'search.beds="3" should != "3"', 'search.beds=3 not >= 4', 'search.beds="3" not >= 4',
                             'search.beds="3" not <= 3', 'search.new=null != 1', 'score.x=null not <= 1'])
    assert got[2] == sorted(["missing score", "search.beds=3 not >= 4", "search.new=null != 1"])
    plain = monitor.trace_failures(calls.select("run", "case", "tools", "answer_chars"), cases.select("case", "need_all", "need_any", "never", F.lit(11).alias("min_chars")))
    assert {r.run: r.failures for r in plain.collect()} == {1: ["answer too short"], 2: ["answer too short", "missing score"]}
