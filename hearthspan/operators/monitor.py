"""Runs, queues, telemetry, gaps, retention: statistics over append-only logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions.rank import group_quantiles, newest, with_previous
from hearthspan.functions.text import tool_count

# Session prefixes of tests and the message prefix of a daily-cap refusal.
TEST_SESSION = r"^(bhv|e2e|dev|prod-ttfb|verify|sim|test)-"
CAP_DENIED = "daily_limit_reached"


def real_sessions(runs: DataFrame, internal_users: list) -> DataFrame:
    """Rows of real users, with cap refusals flagged apart from errors."""
    real = ~F.coalesce("session_id", F.lit("")).rlike(TEST_SESSION)
    rows = runs.where(real & ~F.col("user_id").isin(*internal_users))
    return rows.withColumn("denied", F.coalesce(F.col("error_message").startswith(CAP_DENIED), F.lit(False)))


def telemetry(runs: DataFrame, internal_users: list) -> DataFrame:
    """Turns, sessions, users, errors, refusals and index percentiles of latency per job."""
    rows = real_sessions(runs, internal_users)
    turns = rows.where(~F.col("denied"))
    counts = turns.groupBy("job").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("user_id").alias("users"),
        F.count_if(F.col("status") == "failed").alias("errors"))
    denied = rows.groupBy("job").agg(F.count_if("denied").alias("denied"))
    lat = group_quantiles(turns, ["job"], "latency", {"p50": ("index", 0.5), "p95": ("index", 0.95)}, count=None)
    return counts.join(denied, "job").join(lat, "job", "left")


def state_streak(periods: DataFrame, key: str, burst: int = 50, runs: int = 3) -> DataFrame:
    """Problem state per period and its edges: a burst, or new failures in `runs` consecutive periods.

    periods(key, period, failures) holds one row per key and period, already counted; a streak is the
    distance to the last quiet period.
    """
    w = W.partitionBy(key).orderBy("period")
    quiet = F.max(F.when(F.col("failures") == 0, F.col("seq"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    p = periods.withColumn("seq", F.row_number().over(w)).withColumn("streak", F.col("seq") - F.coalesce(quiet, F.lit(0)))
    p = p.withColumn("problem", ((F.col("failures") >= burst) | (F.col("streak") >= runs)).cast("int"))
    was = F.coalesce(F.lag("problem").over(w), F.lit(0))
    edge = F.when((F.col("problem") == 1) & (was == 0), "onset").when((F.col("problem") == 0) & (was == 1), "clear")
    return p.select(key, "period", "failures", "streak", "problem", edge.alias("edge"))


def queue_stats(runs: DataFrame, as_of_s: int) -> DataFrame:
    """One pass: backlog, lifetime counts and trailing windows per queue."""
    done = F.col("status") == "completed"
    since = lambda sec: done & (F.col("at_s") > as_of_s - sec)
    return runs.where(F.col("at_s") <= as_of_s).groupBy("queue_no").agg(
        F.count_if(F.col("status") == "dispatched").alias("backlog"), F.count_if(done).alias("done_lifetime"), F.count_if(F.col("status") == "failed").alias("failed_lifetime"),
        F.count_if(since(60)).alias("done_1min"), F.count_if(since(600)).alias("done_10min"), F.count_if(since(3600)).alias("done_hour"), F.count_if(since(86400)).alias("done_day"), F.max(F.when(done, F.col("at_s"))).alias("last_done_s"))


def progress(stats: DataFrame) -> DataFrame:
    """Coverage, the rates of one minute (alive just now) and of ten (steady), and time left at each; none is stated while idle."""
    eligible = F.col("backlog") + F.col("done_lifetime")
    rate = {"1min": F.col("done_1min") / 60, "10min": F.col("done_10min") / 600}
    return stats.select(
        "queue_no", eligible.alias("eligible"), F.col("done_lifetime").alias("done"), F.col("backlog").alias("pending"),
        F.round(100.0 * F.col("done_lifetime") / F.greatest(eligible, F.lit(1)), 4).alias("coverage_pct"),
        *[F.round(r, 6).alias(f"per_s_{k}") for k, r in rate.items()], *[F.when(r > 0, F.floor(F.col("backlog") / F.when(r > 0, r))).alias(f"eta_s_{k}") for k, r in rate.items()])


def reconcile(runs: DataFrame, rules: DataFrame, stats: DataFrame, as_of_s: int, min_age_s: int) -> DataFrame:
    """Close old dispatched runs by the health of the queues behind them; every queue must be healthy."""
    old = runs.where((F.col("status") == "dispatched") & (F.col("at_s") < as_of_s - min_age_s)).select("run_id", "job", "at_s")
    j = old.join(rules, "job").join(stats.select("queue_no", "backlog", "last_done_s"), "queue_no", "left")
    caught, moved = F.col("backlog") == 0, F.col("last_done_s") > F.col("at_s")
    ok = F.coalesce(caught | moved, F.lit(False))
    why = F.when(F.col("backlog").isNull(), "no data").when(caught, "caught up").when(moved, "progress since").otherwise("no progress")
    return j.groupBy("run_id").agg(F.when(F.bool_and(ok), "success").otherwise("failed").alias("status"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", F.col("queue_no").cast("string"), why))), "; ").alias("reasons"))


def stale_jobs(runs: DataFrame, budgets: DataFrame, as_of_s: int, catchup_s: int = 180 * 60) -> DataFrame:
    """Latest run per job against its freshness budget; a run that is still going and whose summary says catch-up is exempt."""
    last = newest(runs.select("job", "at_s", "status", "run_id", "summary"), ["job"], ["at_s", "run_id"])
    j = budgets.join(last, "job", "left")
    age = as_of_s - F.col("at_s")
    mode = F.try_variant_get(F.try_parse_json("summary"), "$.mode", "string")
    live = (F.col("status") == "dispatched") & F.coalesce(mode == "catchup", F.lit(False)) & (age <= catchup_s)
    return j.select("job", age.alias("age_s"), F.coalesce(~((age <= F.col("budget_s")) | live), F.lit(True)).cast("int").alias("stale"))


def fix_budget(actions: DataFrame, window_s: int, budget: int) -> DataFrame:
    """Faults with the fixes of the same rule and target in the window before them, the problem that was open and what to do.

    actions(run_id, rule_id, target, at_s, action, faulty): action is fix, escalate, detect or recover; only fixes spend the budget.
    open_problem is the latest action before, unless that was a recovery; a spent budget is escalated once while the problem is open.
    Fixes are tallied per second and cut into buckets one window long; a trailing window touches its own bucket and the one
    before, so no task orders all actions of a busy target.
    """
    keys = ["rule_id", "target"]
    tally = actions.groupBy(*keys, "at_s").agg(F.count_if(F.col("action") == "fix").alias("c")).withColumn("own", F.floor(F.col("at_s") / window_s))
    spread = tally.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    w = W.partitionBy(*keys, "bucket").orderBy("at_s").rangeBetween(-window_s, -1)
    counted = spread.withColumn("in_window", F.coalesce(F.sum("c").over(w), F.lit(0))).where(F.col("own") == F.col("bucket")).select(*keys, "at_s", "in_window")
    dated = actions.withColumn("at", F.timestamp_seconds("at_s"))
    d = with_previous(dated, keys, ["at", "run_id"], ["action"]).drop("at").where("faulty").join(counted, [*keys, "at_s"])
    d = d.withColumn("open_problem", F.when(F.col("prev_action") != "recover", F.col("prev_action")))
    spent, told = F.col("in_window") >= budget, F.coalesce(F.col("open_problem") == "escalate", F.lit(False))
    return d.withColumn("verdict", F.when(~spent, "fix").when(told, "wait").otherwise("escalate"))


def host_alerts(hosts: DataFrame) -> DataFrame:
    """(host, alert): hosts whose state changes, `down` or `up`.

    hosts(host, site, role, age_s, budget_s, was_down, reachable): role 0 is the lead of a site, 1 a host whose alert the lead's stands
    for, 2 any other; reachable tells whether the site's readings could be fetched at all. A host is down when its last report
    is missing or older than its own budget. Readings come by way of the lead: if they cannot be fetched, the lead is down and
    all others are unknown, so they stay as they were. While the lead is down, hosts of role 1 are neither down nor recovered.
    """
    stale = F.col("age_s").isNull() | (F.col("age_s") > F.col("budget_s"))
    down = F.when(F.col("role") == 0, ~F.col("reachable") | stale).when(~F.col("reachable"), F.col("was_down")).otherwise(stale)
    d = hosts.withColumn("down", down)
    dark = d.groupBy("site").agg(F.bool_or((F.col("role") == 0) & F.col("down")).alias("dark"))
    hidden = F.col("dark") & (F.col("role") == 1)
    return d.join(dark, "site").where(~hidden & (F.col("down") != F.col("was_down"))).select("host", F.when(F.col("down"), "down").otherwise("up").alias("alert"))


def version_sweep(rows: DataFrame, current: str, guard: float = 0.5) -> DataFrame:
    """What a version sweep would delete; a table losing more than the guard share is refused whole."""
    g = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("data_version") != current).alias("old"))
    refused = F.col("old") / F.col("total") > guard
    return g.select("table_name", "total", "old", refused.cast("int").alias("refused"), F.when(refused, F.lit(0)).otherwise(F.col("old")).cast("bigint").alias("delete_n"))


def age_sweep(rows: DataFrame, cut_s: int) -> DataFrame:
    """Rows older than the cut, by table. Audit rows are meant to go, so no guard holds them."""
    g = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("at_s") < cut_s).alias("old"))
    return g.select("table_name", "total", "old", F.lit(0).alias("refused"), F.col("old").alias("delete_n"))


def frequent_sweep(rows: DataFrame, cut_s: int, threshold: int) -> DataFrame:
    """Old rows of keys with more than `threshold` rows in all; rarer keys keep their rows forever."""
    g = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("at_s") < cut_s).alias("old"))
    often = F.col("total") > threshold
    return g.select("table_name", "total", "old", F.lit(0).alias("refused"), F.when(often, F.col("old")).otherwise(0).cast("bigint").alias("delete_n"))


def orphan_sweep(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows(table_name, parent) whose parent(parent) is gone. Nothing can read them, so no guard holds them."""
    known = parents.select("parent").distinct().withColumn("_there", F.lit(1))
    g = rows.join(known, "parent", "left").groupBy("table_name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_there").isNull()).alias("old"))
    return g.select("table_name", "total", "old", F.lit(0).alias("refused"), F.col("old").alias("delete_n"))


def retention_plan(sweeps: dict[str, DataFrame]) -> DataFrame:
    """All sweeps in one plan: sweep, table_name, total, old, refused, delete_n."""
    return reduce(DataFrame.unionByName, [d.withColumn("sweep", F.lit(name)) for name, d in sweeps.items()])


def window_holds(before: DataFrame, after: DataFrame, cut_s: int) -> DataFrame:
    """table_name, kept, holds: whether a sweep left every row of the window, which may grow meanwhile but never shrink."""
    inside = lambda d, c: d.groupBy("table_name").agg(F.count_if(F.col("at_s") >= cut_s).alias(c))
    j = inside(before, "_b").join(inside(after, "kept"), "table_name", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return j.select("table_name", "kept", (F.col("kept") >= F.col("_b")).cast("int").alias("holds"))


# ---- capability gaps -----------------------------------------------------------------------------

# Wording by which a reply admits a gap, in the order tried, and its guards.
GAP_PATTERNS = (
    ("no_tool", r"(我的)?工具里没有|没有[^。；\n]{0,14}这类字段|不是从工具里查"),
    ("no_data", r"我没有[^。；\n]{0,16}(数据|记录|字段)|我们没有[^。；\n]{0,16}(数据|记录)"),
    ("scope_limit", r"我的数据覆盖的是|数据覆盖[^。；\n]{0,10}不|覆盖范围[^。；\n]{0,10}不"),
    ("cannot_verify", r"无法(查证|核实|查到)|查不到[^。；\n]{0,10}(字段|数据|记录)"),
    ("en_no_tool", r"(?i)(don't|do not) have (a )?tool|no tool (for|that)|not something (I|we) (can|hold)"),
)
NEGATED = r"(并?不是|并非|而不是|不能说)[^。；\n]{0,6}(我|我们)?(没有|无法|查不到)"
SEARCH_ASKED = r"(?i)帮我(找|搜|推荐)|找几套|给我几套|推荐几套|帮我看看有没有|find me|show me|recommend .{0,16}(propert|flat|home|house)"
NEEDS_REFERENT = r"(?i)类似|像这|这张图|这样的房子|like this|similar to (this|it)"
ENOUGH = (r"(?i)(预算|budget|£|万镑|万英镑|\d\s*k\b|万)|(\d\s*(居|房|卧|bed))|([A-Z]{1,2}\d[A-Z\d]?\b)|(东|西|南|北|中)伦敦|east|west|north|south london")
BOUNDARY = (r"(?i)only covers?\b[^.\n]{0,40}(for[- ]sale|sales|listings|buy(ing)?|purchase)|covers? only\b[^.\n]{0,40}(for[- ]sale|sales|listings|buy(ing)?|purchase)|no inventory of|"
            r"(don'?t|do not|cannot|can'?t) (have|hold|carry|index|pull|search)[^.\n]{0,40}(rental|lettings|to-let|rent\b)|outside (our|my) (data )?coverage|只(覆盖|收录|有)在售|没有租房|不(覆盖|收录)租")
BENCH_SESSION, SIM_SESSION = r"^(cmp-|bhv-|selftest-|test-)", r"^sim-"
CLAUSE = r"[，,。！？；;\n]"


def first_gap(text: Column) -> Column:
    """Struct (label, clause) of the first clause that admits a gap and is not a negated denial.

    The guard reads the clause with the one before it. All of it stays inside the row.
    """
    # fixed value: marks cut from the ends of a clause
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), CLAUSE), lambda c: F.regexp_replace(F.trim(c), r"^[#*>\-\s|]+|[\s|*]+$", ""))
    clauses = F.filter(clean, lambda c: c != "")
    label = lambda c: reduce(lambda acc, p: acc.when(c.rlike(p[1]), p[0]), GAP_PATTERNS, F).otherwise(F.lit(None).cast("string"))
    seen = F.transform(F.sequence(F.lit(1), F.greatest(F.size(clauses), F.lit(1))), lambda n: F.struct(
        F.try_element_at(clauses, n).alias("clause"), F.concat_ws(",", F.when(n > 1, F.try_element_at(clauses, F.greatest(n - 1, F.lit(1)))), F.try_element_at(clauses, n)).alias("window")))
    hits = F.filter(seen, lambda s: s["clause"].isNotNull() & ~s["window"].rlike(NEGATED) & label(s["clause"]).isNotNull())
    first = F.try_element_at(hits, F.lit(1))
    return F.when(first.isNotNull(), F.struct(label(first["clause"]).alias("label"), first["clause"].alias("evidence")))


def gap_source(session: Column, user: Column) -> Column:
    return F.when(session.rlike(BENCH_SESSION), F.lit(None)).when(session.rlike(SIM_SESSION), "sim").when(user == "admin", F.lit(None)).otherwise("real")


def capability_gaps(chats: DataFrame) -> DataFrame:
    """Turns whose reply admits a gap, or that were asked to search with enough constraints and did not."""
    rows = chats.where(F.coalesce("assistant_text", F.lit("")) != "").withColumn("source", gap_source(F.col("session_id"), F.col("user_id").cast("string"))).where("source IS NOT NULL")
    rows = rows.withColumn("tools_used", tool_count(F.col("tool_calls")))
    # explode of a one-element array keeps filters on the reading from being pushed under it and run twice
    rows = rows.withColumn("_gap", F.explode(F.array(first_gap(F.col("assistant_text")))))
    asked = F.trim(F.coalesce("user_text", F.lit("")))
    skipped = (F.col("_gap").isNull() & (F.col("tools_used") == 0) & asked.rlike(SEARCH_ASKED) & asked.rlike(ENOUGH) & ~asked.rlike(NEEDS_REFERENT) & ~F.col("assistant_text").rlike(BOUNDARY))
    label = F.when(F.col("_gap").isNotNull(), F.col("_gap.label")).when(skipped, "search_not_run")
    found = rows.withColumn("label", label).where("label IS NOT NULL")
    # the key leaves out spaces and punctuation, so re-asking the same thing is the same gap
    # fixed value: characters that do not count in a question's key
    question = F.regexp_replace(F.lower(asked), r"[\s，。、？！,.?!；;：:\"'「」『』（）()]+", "")
    return found.select(
        "msg_id", F.substring(F.sha1(F.concat_ws("|", "label", question)), 1, 12).alias("key"), "label", F.when(F.col("tools_used") == 0, "hard").otherwise("partial").alias("severity"),
        "source", "session_id", asked.alias("question"), F.when(F.col("_gap").isNotNull(), F.col("_gap.evidence")).alias("evidence"), "tools_used")


def distinct_gaps(gaps: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("label", "severity", "source", "question"), "msg_id").alias("f")
    return gaps.groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.max("msg_id").alias("last_msg"), first).select("key", "hits", "last_msg", "f.label", "f.severity", "f.source")


# ---- evaluation summaries --------------------------------------------------------------------------

ISSUES = "array<struct<severity:string,category:string,detail:string>>"
# Marks of a judge's own failure and of an answer that was empty, and the judge's levels and kinds of issues.
PARSE_FAILED, CALL_FAILED, NO_ANSWER = "critic output was unparseable", "critic call failed", "empty response"
SEVERITIES = ("high", "medium", "low")
CATEGORIES = ("tool_hallucination", "general_hallucination", "missing_hedge", "off_domain_answered", "format", "incomplete")


def _tallied(rows: DataFrame, keys: list[str], cols: list[str], name: str) -> DataFrame:
    """How often each value of `cols` occurs per group, as text in the order of the values: `a b 3; c d 1`."""
    per = rows.groupBy(*keys, *[F.coalesce(c, F.lit("?")).alias(f"_{c}") for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct(*[f"_{c}" for c in cols], "_n"))), lambda r: F.concat_ws(" ", *[r[f"_{c}"] for c in cols], r["_n"].cast("string")))
    return per.groupBy(*keys).agg(F.array_join(told, "; ").alias(name))


def critic_summary(critic: DataFrame, keys: list[str], detail: str | None = None) -> DataFrame:
    """Verdicts, pass rates with judge failures out of the denominator, and issues by severity, by category and by both.

    Categories besides the known ones are in `issues`, which has every pair of severity and category. Days of scoring and cache
    hits are told of records that have `scored_at` and `cached`; `detail` is an expression that invented tools are looked for by.
    """
    issues = F.coalesce(F.from_json("issues", ISSUES), F.array().cast(ISSUES))
    c = critic.withColumn("_all", issues)
    own = lambda x: F.coalesce(x["detail"].startswith(PARSE_FAILED), F.lit(False))
    c = c.withColumn("_bad", F.exists("_all", own)).withColumn("_real", F.filter("_all", lambda x: ~own(x)))
    of = lambda field, v: F.sum(F.size(F.filter("_real", lambda x: x[field] == v)))
    within = lambda field, v: F.count_if(F.exists("_real", lambda x: x[field] == v))
    call = F.coalesce(F.col("error").startswith(CALL_FAILED), F.lit(False))
    more = []
    if detail is not None:
        more.append(F.sum(F.size(F.filter("_real", lambda x: (x["category"] == "tool_hallucination") & x["detail"].rlike(detail)))).alias("tool_hallucination_matching"))
    if "scored_at" in critic.columns:
        day = F.nullif(F.substring(F.col("scored_at").cast("string"), 1, 10), F.lit(""))
        more += [F.min(day).alias("scored_from"), F.max(day).alias("scored_to")]
    if "cached" in critic.columns:
        more.append(F.count_if("cached").alias("cache_hits"))
    g = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if("_bad").alias("parse_failures"), F.count_if(call).alias("call_failures"),
        F.count_if(F.col("error").contains(NO_ANSWER)).alias("empty_answers"), *[of("severity", s).alias(f"sev_{s}") for s in SEVERITIES], *[of("category", k).alias(k) for k in CATEGORIES],
        within("severity", "high").alias("cases_with_high"), within("category", "tool_hallucination").alias("cases_with_tool_hallucination"), *more)
    judged = F.col("cases") - F.col("parse_failures") - F.col("call_failures")
    g = g.withColumn("pass_rate", F.round(F.col("passed") / F.col("cases"), 6)).withColumn("pass_rate_judged", F.round(F.try_divide(F.col("passed"), judged), 6))
    # groups without a name are groups too
    for told in (_tallied(c, keys, ["verdict"], "verdicts"), _tallied(c.select(*keys, F.inline("_real")), keys, ["severity", "category"], "issues")):
        told = told.select(*[F.col(k).alias(f"_{k}") for k in keys], told.columns[-1])
        g = g.join(told, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.lit(True)), "left").drop(*[f"_{k}" for k in keys])
    return g.withColumn("issues", F.coalesce("issues", F.lit("")))


def answer_summary(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Cases, empty replies, tool calls, mean and median wall time per group."""
    g = answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.trim("response") == "").alias("empty"), F.count("error").alias("errors"), F.round(F.avg(F.length("response")), 6).alias("mean_chars"),
        F.round(F.sum(F.round(F.col("wall_s") * 10).cast("bigint")) / F.count("wall_s") / 10, 6).alias("mean_wall"), F.round(F.avg("tool_calls"), 6).alias("mean_tools"), F.count_if(F.col("tool_calls") == 0).alias("no_tools"))
    mid = group_quantiles(answers, keys, "wall_s", {"median_wall": "median"}, count=None)
    return g.join(mid, keys, "left")


def _read(value: Column) -> tuple[Column, Column, Column]:
    """A variant as JSON text, as a number and as a string; what is missing is null, and true and false are 1 and 0."""
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(~kind.isin("STRING", "VOID") & ~kind.rlike("^(ARRAY|OBJECT)"), F.try_variant_get(value, "$", "double"))
    return F.coalesce(F.to_json(value), F.lit("null")), number, F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))


def _same(a: Column, b: Column, folded: bool = False) -> Column:
    (text, n, s), (other, m, t) = _read(a), _read(b)
    strings = F.lower(s) == F.lower(t) if folded else s == t
    return F.when(n.isNotNull() & m.isNotNull(), n == m).when(s.isNotNull() & t.isNotNull(), strings).otherwise(text == other)


def _refused(check: Column, call: Column) -> Column:
    """What a comparison says against a call of its tool, or null. A missing argument is null; it is equal to null and never in bounds."""
    v, want = F.try_element_at(call["args"], check["arg"]), F.try_parse_json(check["value"])
    (text, n, s), (bound, m, t) = _read(v), _read(want)
    under = F.when(n.isNotNull() & m.isNotNull(), n < m).when(s.isNotNull() & t.isNotNull(), s < t)
    over = F.when(n.isNotNull() & m.isNotNull(), n > m).when(s.isNotNull() & t.isNotNull(), s > t)
    among = F.exists(F.coalesce(F.try_variant_get(want, "$", "array<variant>"), F.array().cast("array<variant>")), lambda x: _same(v, x, True))
    says = lambda bad, sign: F.when(bad, F.concat(check["tool"], F.lit("."), check["arg"], F.lit("="), text, F.lit(f" {sign} "), bound))
    op, yes = check["op"], F.lit(True)
    return F.when(call["tool"] == check["tool"], F.when(op == "equals", says(~_same(v, want), "!=")).when(op == "not_equals", says(_same(v, want), "should !=")).when(op == "in", says(~among, "not in"))
                  .when(op == "gte", says(F.coalesce(under, yes), "not >=")).when(op == "lte", says(F.coalesce(over, yes), "not <=")))


def trace_failures(calls: DataFrame, cases: DataFrame) -> DataFrame:
    """Failures per run: required, any-of and forbidden tools, a shortest answer, comparisons of arguments, and errors.

    calls(run, tools array<string>, answer_chars, case) and, where they are known, calls array<struct<tool string, args map<string,variant>>>,
    errors array<string>, done boolean, rc int; cases(case, need_all, need_any, never, min_chars) and checks
    array<struct<tool, arg, op, value>>, no_error. op is equals, not_equals, in, gte or lte, value is JSON; every call of the tool is compared.
    """
    empty = F.array().cast("array<string>")
    j = calls.join(F.broadcast(cases), "case")
    listed = lambda c: F.coalesce(F.col(c), empty)
    one = lambda bad, text: F.when(bad, F.array(text))
    found = [
        F.transform(F.array_except(listed("need_all"), listed("tools")), lambda t: F.concat(F.lit("missing "), t)),
        F.transform(F.array_intersect(listed("never"), listed("tools")), lambda t: F.concat(F.lit("forbidden "), t)),
        one((F.size(listed("need_any")) > 0) & (F.size(F.array_intersect(listed("need_any"), listed("tools"))) == 0), F.lit("none of the expected tools")),
        one(F.col("answer_chars") < F.col("min_chars"), F.lit("answer too short"))]
    if "checks" in cases.columns and "calls" in calls.columns:
        said = F.flatten(F.transform("checks", lambda k: F.transform("calls", lambda c: _refused(k, c))))
        found.append(F.filter(said, lambda x: x.isNotNull()))
    if "no_error" in cases.columns:
        if "errors" in calls.columns:
            found.append(one(F.col("no_error") & (F.size(listed("errors")) > 0), F.concat(F.lit("errors "), F.array_join("errors", ", "))))
        if "done" in calls.columns:
            found.append(one(F.col("no_error") & ~F.coalesce("done", F.lit(False)), F.lit("not done")))
    if "rc" in calls.columns:
        found.append(one(F.col("rc") != 0, F.concat(F.lit("rc "), F.col("rc").cast("string"))))
    return j.withColumn("failures", F.array_sort(F.concat(*[F.coalesce(f, empty) for f in found])))


# ---- orientation readings ---------------------------------------------------------------------------

def north_gate(present: Column, spread: Column, prob: Column, tau: float = 10.0, least: float = 0.4) -> Column:
    """Reason in fixed order; 'pass' means emit."""
    return (F.when(present.isNull(), "detect_failed").when(present == 0, "absent").when(prob < least, "presence").when(spread.isNull() | F.isnan(spread), "unread")
            .when(spread > tau, "spread").otherwise("pass"))


def circular_combine(readings: DataFrame, key: str, angle: str, tol: float = 15.0) -> DataFrame:
    """Circular mean per property, only when all readings lie within `tol` degrees (1 at least) of each other.

    Readings are tallied by whole degree, with the least and greatest of each: at most 360 rows a property, however many
    different angles it has. If the largest gap between filled degrees is at least 360 - tol, all lie in one arc of tol.
    """
    a = F.pmod(F.col(angle), F.lit(360.0))
    cells = readings.where(F.col(angle).isNotNull()).groupBy(key, F.floor(a).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(a).alias("lo"), F.max(a).alias("hi"), F.sum(F.sin(F.radians(a))).alias("_s"), F.sum(F.cos(F.radians(a))).alias("_o"))
    g = cells.groupBy(key).agg(F.sum("_c").alias("n"), F.sum("_s").alias("s"), F.sum("_o").alias("c"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("at"))
    k = F.size("at")
    over = lambda i: F.element_at("at", F.least(i + 1, k))["lo"] - F.element_at("at", i)["hi"]
    around = F.element_at("at", 1)["lo"] + 360 - F.element_at("at", k)["hi"]
    gap = F.array_max(F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i < k, over(i)).otherwise(around)))
    tight = (k == 1) | (gap >= 360 - tol)
    mean = F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0))
    return g.select(key, "n", F.when(tight, mean).alias("mean"), tight.cast("int").alias("emitted"))


def gate_curve(readings: DataFrame, thresholds=(5, 10, 15, 20, 30)) -> DataFrame:
    """Yield and precision at each spread threshold."""
    d = F.pmod(F.col("truth") - F.col("pred"), F.lit(360.0))
    err = F.least(d, 360 - d)
    aggs = [F.count(F.lit(1)).alias("n")]
    for t in thresholds:
        in_gate = F.col("spread") <= t
        aggs += [F.count_if(in_gate).alias(f"k{t}"), F.count_if(in_gate & (err <= 22.5)).alias(f"a{t}"), F.count_if(in_gate & (err <= 30)).alias(f"b{t}")]
    one = readings.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("tau"), F.col(f"k{t}").alias("emitted"), (F.col(f"k{t}") / F.col("n")).alias("yield"), F.try_divide(F.col(f"a{t}"), F.col(f"k{t}")).alias("prec22"), F.try_divide(F.col(f"b{t}"), F.col(f"k{t}")).alias("prec30")) for t in thresholds])
    return one.select(F.inline(rows))


def emission_scores(readings: DataFrame) -> DataFrame:
    """Raw, three-of-four and all-four gating of frame answers against the truth, with the constant baseline."""
    good = F.filter(F.array("f1", "f2", "f3", "f4"), lambda v: v >= 0)
    votes = F.transform(F.array(*[F.lit(v) for v in range(4)]), lambda v: F.struct(F.size(F.filter(good, lambda x: x == v)).alias("n"), v.alias("v")))
    top = F.array_max(votes)
    maj = F.when(top["n"] >= 3, top["v"])
    same = F.when(top["n"] == 4, top["v"])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), c.cast("bigint").alias("said")) for m, c in (("raw", F.when(F.col("f1") >= 0, F.col("f1"))), ("maj3", maj), ("eq4", same), ("always0", F.lit(0)))])
    said = readings.select("side", F.inline(modes))
    g = said.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("emitted"), F.count_if(F.col("said") == F.col("side")).alias("hit"))
    return g.select("mode", "n", "emitted", "hit", (F.col("emitted") / F.col("n")).alias("yield"), F.try_divide(F.col("hit"), F.col("emitted")).alias("precision"))
