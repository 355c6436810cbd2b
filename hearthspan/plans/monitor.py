"""Monitoring, telemetry and evaluation queries."""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthspan.functions import labels as lab
from hearthspan.functions.rank import group_quantiles, newest
from hearthspan.operators import monitor as op
from hearthspan.plans.base import query

INTERNAL = [3, 17, 42]
AT = 1706400000  # 2024-01-28 00:00 UTC, inside the event span
_REAL = "NOT regexp_matches(coalesce(session_id, ''), '^(bhv|e2e|dev|prod-ttfb|verify|sim|test)-') AND user_id NOT IN (3, 17, 42)"
_DENY = "coalesce(error_message LIKE 'daily_limit_reached%', false)"


@query("filter_internal_sessions", f"SELECT job, CASE WHEN {_DENY} THEN 1 ELSE 0 END AS denied, count(*) AS n FROM runs WHERE {_REAL} GROUP BY ALL", "runs")
def _(i):
    return op.real_sessions(i.runs, INTERNAL).groupBy("job", F.col("denied").cast("int").alias("denied")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_telemetry", f"""WITH r AS (SELECT * FROM runs WHERE {_REAL}), t AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY latency) - 1 AS k, count(*) OVER (PARTITION BY job) AS n FROM r WHERE NOT {_DENY})
  SELECT job, count(*) AS turns, count(DISTINCT session_id) AS sessions, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE status = 'failed') AS errors, (SELECT count(*) FROM r WHERE r.job = t.job AND {_DENY}) AS denied,
   max(latency) FILTER (WHERE k = least(floor(n * 0.5), n - 1)) AS p50, max(latency) FILTER (WHERE k = least(floor(n * 0.95), n - 1)) AS p95 FROM t GROUP BY job""", "runs")
def _(i):
    return op.telemetry(i.runs, INTERNAL)


@query("agg_tool_usage", """SELECT x.t AS tool, count(*) AS n, count(*) FILTER (WHERE x.a) AS with_n FROM chats, (VALUES (0, 'search', true), (0, 'score', false), (3, 'score', false), (3, 'comps', false), (3, 'score', false)) x(m, t, a) WHERE (conv_id + turn) % 4 = x.m GROUP BY ALL""", "chats")
def _(i):
    calls = F.from_json("tool_calls", "array<struct<tool:string,args:map<string,int>>>", {"mode": "PERMISSIVE"})
    rows = i.chats.select(F.inline(calls)).where("tool IS NOT NULL")
    return rows.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("args").isNotNull()).alias("with_n"))


_CRIT = """count(*) AS cases, count(*) FILTER (WHERE verdict = 'pass') AS passed, count(*) FILTER (WHERE case_id % 5 = 2) AS parse_failures, count(*) FILTER (WHERE case_id % 17 = 0) AS call_failures,
  count(*) FILTER (WHERE case_id % 5 IN (1, 4)) AS sev_high, count(*) FILTER (WHERE case_id % 5 = 3) AS sev_medium, count(*) FILTER (WHERE case_id % 5 = 1) AS sev_low, count(*) FILTER (WHERE case_id % 5 = 1) AS tool_hallucination, count(*) FILTER (WHERE case_id % 5 IN (1, 4)) AS cases_with_high,
  count(*) FILTER (WHERE error LIKE '%empty response%') AS empty_answers, 0::BIGINT AS general_hallucination, count(*) FILTER (WHERE case_id % 5 = 4) AS missing_hedge, 0::BIGINT AS off_domain_answered, count(*) FILTER (WHERE case_id % 5 = 1) AS format,
  count(*) FILTER (WHERE case_id % 5 = 3) AS incomplete, count(*) FILTER (WHERE case_id % 5 = 1) AS cases_with_tool_hallucination,
  round(count(*) FILTER (WHERE verdict = 'pass') * 1.0 / count(*), 6) AS pass_rate, round(count(*) FILTER (WHERE verdict = 'pass') * 1.0 / nullif(count(*) - count(*) FILTER (WHERE case_id % 5 = 2) - count(*) FILTER (WHERE case_id % 17 = 0), 0), 6) AS pass_rate_judged"""


_TOLD = """vd AS (SELECT source_file, string_agg(coalesce(verdict, '?') || ' ' || n, '; ' ORDER BY coalesce(verdict, '?')) AS verdicts FROM (SELECT source_file, verdict, count(*) AS n FROM critic GROUP BY ALL) GROUP BY source_file),
  sc AS (SELECT source_file, string_agg(what || ' ' || n, '; ' ORDER BY what) AS issues FROM (SELECT source_file, what, count(*) AS n FROM
  (SELECT source_file, unnest(CASE case_id % 5 WHEN 1 THEN ['high tool_hallucination', 'low format'] WHEN 3 THEN ['medium incomplete'] WHEN 4 THEN ['high missing_hedge'] ELSE [] END) AS what FROM critic) GROUP BY ALL) GROUP BY source_file)"""


@query("agg_critic_summary", f"""WITH {_TOLD} SELECT cs.*, verdicts, coalesce(issues, '') AS issues FROM (SELECT source_file, {_CRIT} FROM critic GROUP BY source_file) cs
  LEFT JOIN vd ON vd.source_file IS NOT DISTINCT FROM cs.source_file LEFT JOIN sc ON sc.source_file IS NOT DISTINCT FROM cs.source_file""", "critic")
def _(i):
    return op.critic_summary(i.critic, ["source_file"])


_ANS = """count(*) AS cases, count(*) FILTER (WHERE trim(response) = '') AS empty, count(error) AS errors, round(avg(length(response)), 6) AS mean_chars, round(sum(round(wall_s * 10)::BIGINT) / count(wall_s) / 10, 6) AS mean_wall,
  round(avg(tool_calls), 6) AS mean_tools, count(*) FILTER (WHERE tool_calls = 0) AS no_tools, median(wall_s) AS median_wall"""


@query("agg_answer_summary", f"SELECT model, {_ANS} FROM answers GROUP BY model", "answers")
def _(i):
    return op.answer_summary(i.answers, ["model"])


@query("agg_group_compare", f"SELECT grp, model, thinking, {_ANS} FROM answers GROUP BY grp, model, thinking", "answers")
def _(i):
    return op.answer_summary(i.answers, ["grp", "model", "thinking"])


@query("agg_image_per_property", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY score) - 1 AS k, count(*) OVER (PARTITION BY property_id) AS n FROM images)
  SELECT property_id, count(*) AS n, count(*) FILTER (WHERE is_interior = 1) AS n_interior, round(avg(score), 8) AS mean, max(score) AS hi, round(stddev_pop(score), 8) AS sd, max(score) FILTER (WHERE k = floor(n * 0.25)) AS p25, max(score) FILTER (WHERE k = least(n - 1, floor(n * 0.75))) AS p75,
   round(max(score) - avg(score), 8) AS spread, round(avg(score) FILTER (WHERE is_interior = 1), 8) AS interior_mean FROM o GROUP BY property_id""", "images")
def _(i):
    g = i.images.groupBy("property_id").agg(
        F.count_if(F.col("is_interior") == 1).alias("n_interior"), F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("hi"), F.round(F.stddev_pop("score"), 8).alias("sd"),
        F.round(F.max("score") - F.avg("score"), 8).alias("spread"), F.round(F.avg(F.when(F.col("is_interior") == 1, F.col("score"))), 8).alias("interior_mean"))
    return g.join(group_quantiles(i.images, ["property_id"], "score", {"p25": ("index", 0.25), "p75": ("index", 0.75)}), "property_id")


_ERR = "least((((truth - pred) % 360) + 360) % 360, 360 - (((truth - pred) % 360) + 360) % 360)"


@query("agg_gate_curve", f"SELECT t.tau, count(*) FILTER (WHERE spread <= tau) AS emitted, count(*) FILTER (WHERE spread <= tau) * 1.0 / count(*) AS yield, count(*) FILTER (WHERE spread <= tau AND {_ERR} <= 22.5) * 1.0 / count(*) FILTER (WHERE spread <= tau) AS prec22, count(*) FILTER (WHERE spread <= tau AND {_ERR} <= 30) * 1.0 / count(*) FILTER (WHERE spread <= tau) AS prec30 FROM readings, (VALUES (5), (10), (15), (20), (30)) t(tau) GROUP BY t.tau", "readings")
def _(i):
    return op.gate_curve(i.readings)


_CNT = "(CASE WHEN f1 = {v} THEN 1 ELSE 0 END + CASE WHEN f2 = {v} THEN 1 ELSE 0 END + CASE WHEN f3 = {v} THEN 1 ELSE 0 END + CASE WHEN f4 = {v} THEN 1 ELSE 0 END)"
_MODE = lambda least: "CASE " + " ".join(f"WHEN {_CNT.format(v=v)} >= {least} THEN {v}" for v in range(4)) + " END"


@query("agg_emission_scores", f"""WITH s AS (SELECT 'raw' AS mode, f1 AS said, side FROM readings UNION ALL SELECT 'maj3', {_MODE(3)}, side FROM readings UNION ALL SELECT 'eq4', {_MODE(4)}, side FROM readings UNION ALL SELECT 'always0', 0, side FROM readings)
  SELECT mode, count(*) AS n, count(said) AS emitted, count(*) FILTER (WHERE said = side) AS hit, count(said) * 1.0 / count(*) AS yield, count(*) FILTER (WHERE said = side) * 1.0 / count(said) AS precision FROM s GROUP BY mode""", "readings")
def _(i):
    return op.emission_scores(i.readings)


@query("agg_circular_mean", f"""WITH r AS (SELECT property_id, truth FROM readings), w AS (SELECT a.property_id, max(least(abs(a.truth - b.truth), 360 - abs(a.truth - b.truth))) AS wide FROM r a JOIN r b USING (property_id) GROUP BY ALL)
  SELECT property_id, count(*) AS n, CASE WHEN wide <= 15 THEN round(((degrees(atan2(sum(sin(radians(truth))), sum(cos(radians(truth))))) % 360) + 360) % 360, 4) END AS mean, CASE WHEN wide <= 15 THEN 1 ELSE 0 END AS emitted FROM r JOIN w USING (property_id) GROUP BY property_id, wide""", "readings")
def _(i):
    return op.circular_combine(i.readings, "property_id", "truth").withColumn("mean", F.round("mean", 4))


@query("north_gate", """SELECT CASE WHEN present IS NULL THEN 'detect_failed' WHEN present = 0 THEN 'absent' WHEN presence_prob < 0.4 THEN 'presence' WHEN spread > 10 THEN 'spread' ELSE 'pass' END AS reason, count(*) AS n FROM readings GROUP BY 1""", "readings")
def _(i):
    return i.readings.groupBy(op.north_gate(F.col("present"), F.col("spread"), F.col("presence_prob")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_SETS = "list_distinct([f1, f2]) AS a, list_distinct([f3, side]) AS b"


@query("agg_side_precision", f"""SELECT property_id, sum(len(list_intersect(a, b)))::BIGINT AS right_n, sum(len(a))::BIGINT AS said_n, sum(len(b))::BIGINT AS true_n, count(*) FILTER (WHERE list_sort(a) = list_sort(b)) AS exact_n, sum(len(list_intersect(a, b))) / sum(len(a)) AS precision, sum(len(list_intersect(a, b))) / sum(len(b)) AS recall FROM (SELECT property_id, {_SETS} FROM readings) t GROUP BY property_id""", "readings")
def _(i):
    a, b = F.array_distinct(F.array("f1", "f2")), F.array_distinct(F.array("f3", "side"))
    both = F.size(F.array_intersect(a, b))
    g = i.readings.groupBy("property_id").agg(F.sum(both).alias("right_n"), F.sum(F.size(a)).alias("said_n"), F.sum(F.size(b)).alias("true_n"), F.count_if(F.array_sort(a) == F.array_sort(b)).alias("exact_n"))
    return g.withColumn("precision", F.col("right_n") / F.col("said_n")).withColumn("recall", F.col("right_n") / F.col("true_n"))


@query("set_route_intersection", "SELECT reading_id, property_id, array_to_string(list_sort(list_intersect([f1, f2], [f3, f4])), ',') AS sides FROM (SELECT DISTINCT reading_id, property_id, f1, f2, f3, f4 FROM readings) r", "readings")
def _(i):
    r = i.readings.select("reading_id", "property_id", "f1", "f2", "f3", "f4").distinct()
    return r.select("reading_id", "property_id", F.array_join(F.transform(F.array_sort(F.array_intersect(F.array("f1", "f2"), F.array("f3", "f4"))), lambda x: x.cast("string")), ",").alias("sides"))


@query("agg_spend_by_key", "SELECT job, strftime(started_at, '%Y-%m-%d') AS day, count(*) AS calls, round(sum(latency), 4) AS cost, floor(sum(round(latency * 100)::BIGINT) / 100 / 500)::BIGINT AS bucket FROM runs GROUP BY ALL", "runs")
def _(i):
    cents = F.sum(F.round(F.col("latency") * 100).cast("bigint"))
    g = i.runs.groupBy("job", F.date_format("started_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), cents.alias("_c"))
    return g.select("job", "day", "calls", F.round(F.col("_c") / 100, 4).alias("cost"), F.floor(F.col("_c") / 100 / 500).alias("bucket"))


@query("agg_run_frequency", "SELECT user_id, count(*) AS n FROM runs GROUP BY user_id HAVING count(*) > 70", "runs")
def _(i):
    return i.runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 70")


def chats(i):
    # some sessions are benchmark or simulated ones; user 'admin' is internal
    k = F.col("conv_id")
    sid = F.when(k % 10 == 9, F.concat(F.lit("cmp-"), "session_id")).when(k % 10 == 8, F.concat(F.lit("sim-"), "session_id")).otherwise(F.col("session_id"))
    return i.chats.withColumn("session_id", sid).withColumn("user_id", F.when(k % 10 == 7, "admin").otherwise("u"))


_GAP = """g AS (SELECT msg_id, conv_id, turn, CASE conv_id % 10 WHEN 8 THEN 'sim' ELSE 'real' END AS source, user_text, CASE WHEN (conv_id + turn) % 4 IN (1, 2) THEN 0 WHEN (conv_id + turn) % 4 = 0 THEN 2 ELSE 3 END AS tools_used,
   CASE (conv_id * 7 + turn) % 9 WHEN 0 THEN 'en_no_tool' WHEN 2 THEN 'no_data' WHEN 1 THEN NULL WHEN 3 THEN NULL END AS said, (conv_id * 7 + turn) % 9 = 3 AS bounded FROM chats WHERE conv_id % 10 NOT IN (7, 9)),
 gaps AS (SELECT *, coalesce(said, CASE WHEN tools_used = 0 AND (conv_id + turn) % 5 = 0 AND NOT bounded THEN 'search_not_run' END) AS label FROM g)"""


@query("capability_gaps", f"WITH {_GAP} SELECT msg_id, label, CASE WHEN tools_used = 0 THEN 'hard' ELSE 'partial' END AS severity, source, tools_used FROM gaps WHERE label IS NOT NULL", "chats")
def _(i):
    return op.capability_gaps(chats(i)).select("msg_id", "label", "severity", "source", "tools_used")


@query("agg_gaps_distinct", f"""WITH {_GAP}, k AS (SELECT *, left(sha1(label || '|' || regexp_replace(lower(trim(user_text)), '[\\s，。、？！,.?!；;：:"''「」『』（）()]+', '', 'g')), 12) AS key FROM gaps WHERE label IS NOT NULL)
  SELECT key, count(*) AS hits, max(msg_id) AS last_msg, arg_min(label, msg_id) AS label FROM k GROUP BY key""", "chats")
def _(i):
    gaps = op.capability_gaps(chats(i))
    return op.distinct_gaps(gaps).select("key", "hits", "last_msg", "label")


@query("trace_assertions", """WITH m AS (SELECT msg_id, (conv_id + turn) % 4 AS m, length(assistant_text) < 40 AS short FROM chats)
  SELECT msg_id, concat_ws(';', CASE WHEN short THEN 'answer too short' END, CASE WHEN m = 3 THEN 'comps.n=null not >= 1' END, CASE WHEN m = 3 THEN 'forbidden comps' END, CASE WHEN m IN (1, 2) THEN 'missing score' END,
   CASE WHEN m IN (1, 2) THEN 'none of the expected tools' END, CASE WHEN m = 0 THEN 'search.n=3 not <= 2' END, CASE WHEN m = 0 THEN 'search.n=3 not in [1,null,"3"]' END, CASE WHEN m = 0 THEN 'search.n=3 should != 3' END) AS raw FROM m""", "chats")
def _(i):
    read = F.filter(F.from_json("tool_calls", "array<struct<tool:string,args:map<string,variant>>>"), lambda c: c["tool"].isNotNull())
    # one reading of the calls serves the names and the comparisons
    rows = i.chats.select("msg_id", "assistant_text", F.explode(F.array(read)).alias("calls"))
    runs = rows.select("msg_id", F.transform("calls", lambda c: c["tool"]).alias("tools"), "calls", F.length("assistant_text").alias("answer_chars"), F.lit("default").alias("case"))
    checks = [("search", "n", "lte", "2"), ("search", "n", "gte", "1"), ("search", "n", "in", '[1, null, "3"]'), ("search", "n", "equals", "3.0"), ("search", "n", "not_equals", "3"), ("comps", "n", "equals", "null"), ("comps", "n", "gte", "1")]
    asked = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("tool", "arg", "op", "value"), c)]) for c in checks])
    cases = i.spark.sql("SELECT 'default' AS case, array('score') AS need_all, array('search', 'comps') AS need_any, array('comps') AS never, 40 AS min_chars").withColumn("checks", asked)
    return op.trace_failures(runs, cases).select("msg_id", F.array_join("failures", ";").alias("raw"))


@query("queue_stats", f"""SELECT queue_no, count(*) FILTER (WHERE status = 'dispatched') AS backlog, count(*) FILTER (WHERE status = 'completed') AS done_lifetime, count(*) FILTER (WHERE status = 'failed') AS failed_lifetime, count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 60) AS done_1min, count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 600) AS done_10min,
  count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 3600) AS done_hour, count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 86400) AS done_day, max(at_s) FILTER (WHERE status = 'completed') AS last_done_s FROM runs WHERE at_s <= {AT} GROUP BY queue_no""", "runs")
def _(i):
    return op.queue_stats(i.runs, AT)


@query("progress_report", f"""WITH s AS (SELECT queue_no, count(*) FILTER (WHERE status = 'dispatched') AS b, count(*) FILTER (WHERE status = 'completed') AS d, count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 60) AS m, count(*) FILTER (WHERE status = 'completed' AND at_s > {AT} - 600) AS r FROM runs WHERE at_s <= {AT} GROUP BY queue_no)
  SELECT queue_no, b + d AS eligible, d AS done, b AS pending, round(100.0 * d / greatest(b + d, 1), 4) AS coverage_pct, round(m / 60, 6) AS per_s_1min, round(r / 600, 6) AS per_s_10min, CASE WHEN m > 0 THEN floor(b / (m / 60))::BIGINT END AS eta_s_1min, CASE WHEN r > 0 THEN floor(b / (r / 600))::BIGINT END AS eta_s_10min FROM s""", "runs")
def _(i):
    return op.progress(op.queue_stats(i.runs, AT))


@query("reconcile_runs", f"""WITH s AS (SELECT queue_no, count(*) FILTER (WHERE status = 'dispatched') AS b, max(at_s) FILTER (WHERE status = 'completed') AS l FROM runs WHERE at_s <= {AT} GROUP BY queue_no), ru(job, queue_no) AS (VALUES ('view', 1), ('view', 2), ('click', 3), ('signup', 99), ('purchase', 5)),
  j AS (SELECT r.run_id, ru.queue_no, CASE WHEN b IS NULL THEN 'no data' WHEN b = 0 THEN 'caught up' WHEN l > r.at_s THEN 'progress since' ELSE 'no progress' END AS why FROM runs r JOIN ru USING (job) LEFT JOIN s ON s.queue_no = ru.queue_no WHERE r.status = 'dispatched' AND r.at_s < {AT} - 7200)
  SELECT run_id, CASE WHEN bool_and(why IN ('caught up', 'progress since')) THEN 'success' ELSE 'failed' END AS status, string_agg(queue_no || ' ' || why, '; ' ORDER BY queue_no || ' ' || why) AS reasons FROM j GROUP BY run_id""", "runs")
def _(i):
    rules = i.spark.sql("SELECT * FROM VALUES ('view', 1L), ('view', 2L), ('click', 3L), ('signup', 99L), ('purchase', 5L) AS t(job, queue_no)")
    return op.reconcile(i.runs, rules, op.queue_stats(i.runs, AT), AT, 7200)


@query("stale_jobs", f"""WITH l AS (SELECT job, at_s, status, summary FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY at_s DESC, run_id DESC) AS q FROM runs WHERE at_s <= {AT}) WHERE q = 1), b(job, budget_s) AS (VALUES ('view', 60), ('click', 600), ('signup', 86400), ('error', 5), ('purchase', 1), ('ghost', 60))
  SELECT job, {AT} - at_s AS age_s, CASE WHEN at_s IS NULL THEN 1 WHEN {AT} - at_s <= budget_s OR (status = 'dispatched' AND {AT} - at_s <= 10800 AND coalesce(json_valid(summary), false) AND CASE WHEN json_valid(summary) THEN json_extract_string(summary, '$.mode') = 'catchup' ELSE false END) THEN 0 ELSE 1 END AS stale FROM b LEFT JOIN l USING (job)""", "runs")
def _(i):
    budgets = i.spark.sql("SELECT * FROM VALUES ('view', 60L), ('click', 600L), ('signup', 86400L), ('error', 5L), ('purchase', 1L), ('ghost', 60L) AS t(job, budget_s)")
    return op.stale_jobs(i.runs.where(F.col("at_s") <= AT), budgets, AT)


@query("backlog_stale_alert", f"""SELECT queue_no, count(*) FILTER (WHERE status = 'dispatched') AS pending, CASE WHEN count(*) FILTER (WHERE status = 'dispatched') < 50 THEN 'healthy' WHEN max(at_s) FILTER (WHERE status = 'completed') IS NULL THEN 'never ran' WHEN {AT} - max(at_s) FILTER (WHERE status = 'completed') > 1800 THEN 'behind' ELSE 'healthy' END AS state FROM runs WHERE at_s <= {AT} GROUP BY queue_no""", "runs")
def _(i):
    s = op.queue_stats(i.runs, AT)
    state = F.when(F.col("backlog") < 50, "healthy").when(F.col("last_done_s").isNull(), "never ran").when(AT - F.col("last_done_s") > 1800, "behind").otherwise("healthy")
    return s.select("queue_no", F.col("backlog").alias("pending"), state.alias("state"))


@query("error_burst", f"SELECT job, count(*) AS n FROM runs WHERE status = 'failed' AND error_message LIKE '%database is locked%' AND at_s BETWEEN {AT} - 864000 AND {AT} GROUP BY job", "runs")
def _(i):
    rows = i.runs.where((F.col("status") == "failed") & F.col("error_message").contains("database is locked") & F.col("at_s").between(AT - 864000, AT))
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("n"))


_CUT = AT - 14 * 86400  # two weeks here: the given log spans one month


@query("retention_plan", f"""SELECT 'version' AS sweep, 'dim_' || right(postcode, 2) AS table_name, count(*) AS total, count(*) FILTER (WHERE data_version <> 'v2') AS old, CASE WHEN count(*) FILTER (WHERE data_version <> 'v2') * 1.0 / count(*) > 0.5 THEN 1 ELSE 0 END AS refused,
  CASE WHEN count(*) FILTER (WHERE data_version <> 'v2') * 1.0 / count(*) > 0.5 THEN 0 ELSE count(*) FILTER (WHERE data_version <> 'v2') END AS delete_n, NULL::BIGINT AS kept, NULL::INT AS holds FROM score_docs GROUP BY 2
  UNION ALL SELECT 'age', job, count(*), count(*) FILTER (WHERE at_s < {_CUT}), 0, count(*) FILTER (WHERE at_s < {_CUT}), count(*) FILTER (WHERE at_s >= {_CUT}), 1 FROM runs GROUP BY job
  UNION ALL SELECT 'frequent', 'user ' || user_id, count(*), count(*) FILTER (WHERE at_s < {_CUT}), 0, CASE WHEN count(*) > 60 THEN count(*) FILTER (WHERE at_s < {_CUT}) ELSE 0 END, NULL, NULL FROM runs GROUP BY user_id
  UNION ALL SELECT 'orphan', model_tag, count(*), count(*) FILTER (WHERE l.id IS NULL), 0, count(*) FILTER (WHERE l.id IS NULL), NULL, NULL FROM images i LEFT JOIN (SELECT id FROM listings WHERE delisted_date IS NULL) l ON l.id = i.property_id GROUP BY model_tag""", "score_docs runs images listings")
def _(i):
    docs = i.score_docs.withColumn("table_name", F.concat(F.lit("dim_"), F.substring("postcode", -2, 2)))
    jobs = i.runs.select(F.col("job").alias("table_name"), "at_s")
    users = i.runs.select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("table_name"), "at_s")
    images = i.images.select(F.col("model_tag").alias("table_name"), F.col("property_id").alias("parent"))
    live = i.listings.where("delisted_date IS NULL").select(F.col("id").alias("parent"))
    plan = op.retention_plan({"version": op.version_sweep(docs, "v2"), "age": op.age_sweep(jobs, _CUT), "frequent": op.frequent_sweep(users, _CUT, 60), "orphan": op.orphan_sweep(images, live)})
    # what the age sweep would leave still holds the whole window
    held = op.window_holds(jobs, jobs.where(F.col("at_s") >= _CUT), _CUT).withColumn("sweep", F.lit("age"))
    return plan.join(held, ["sweep", "table_name"], "left")


_PERIODS = "per AS (SELECT queue_no, floor(at_s / 21600)::BIGINT AS period, count(*) FILTER (WHERE error_message = 'database is locked') AS failures FROM runs GROUP BY ALL)"


@query("win_state_streak", f"""WITH {_PERIODS}, s AS (SELECT *, row_number() OVER (PARTITION BY queue_no ORDER BY period) AS seq FROM per), i AS (SELECT *, sum(CASE WHEN failures = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY queue_no ORDER BY period) AS isl FROM s),
  st AS (SELECT *, CASE WHEN failures = 0 THEN 0 ELSE row_number() OVER (PARTITION BY queue_no, isl ORDER BY period) - CASE WHEN isl > 0 THEN 1 ELSE 0 END END AS streak FROM i), p AS (SELECT *, CASE WHEN failures >= 8 OR streak >= 3 THEN 1 ELSE 0 END AS problem FROM st)
  SELECT queue_no, period, failures, streak, problem, CASE WHEN problem = 1 AND coalesce(lag(problem) OVER w, 0) = 0 THEN 'onset' WHEN problem = 0 AND lag(problem) OVER w = 1 THEN 'clear' END AS edge FROM p WINDOW w AS (PARTITION BY queue_no ORDER BY period)""", "runs")
def _(i):
    per = i.runs.groupBy("queue_no", F.floor(F.col("at_s") / 21600).alias("period")).agg(F.count_if(F.col("error_message") == "database is locked").alias("failures"))
    return op.state_streak(per, "queue_no", burst=8)


@query("win_fix_budget", """WITH a AS (SELECT run_id, job AS rule_id, queue_no AS target, at_s, status = 'failed' AS faulty, CASE WHEN status = 'completed' THEN 'recover' WHEN status = 'dispatched' THEN 'detect' WHEN run_id % 4 = 0 THEN 'escalate' ELSE 'fix' END AS action FROM runs),
  p AS (SELECT *, nullif(lag(action) OVER (PARTITION BY rule_id, target ORDER BY at_s, run_id), 'recover') AS open_problem FROM a),
  c AS (SELECT p.*, (SELECT count(*) FROM a b WHERE b.action = 'fix' AND b.rule_id = p.rule_id AND b.target = p.target AND b.at_s BETWEEN p.at_s - 21600 AND p.at_s - 1) AS in_window FROM p WHERE faulty)
  SELECT run_id, rule_id, target, in_window, open_problem, CASE WHEN in_window < 1 THEN 'fix' WHEN open_problem = 'escalate' THEN 'wait' ELSE 'escalate' END AS verdict FROM c""", "runs")
def _(i):
    status = F.col("status")
    action = F.when(status == "completed", "recover").when(status == "dispatched", "detect").when(F.col("run_id") % 4 == 0, "escalate").otherwise("fix")
    acts = i.runs.select("run_id", F.col("job").alias("rule_id"), F.col("queue_no").alias("target"), "at_s", action.alias("action"), (status == "failed").alias("faulty"))
    return op.fix_budget(acts, 21600, 1).select("run_id", "rule_id", "target", "in_window", "open_problem", "verdict")


@query("win_latest_per_key", "SELECT postcode, data_version, doc_no, price FROM (SELECT *, row_number() OVER (PARTITION BY postcode, data_version ORDER BY created_on DESC, doc_no DESC, tie2 DESC, tie3 DESC, price DESC) AS q FROM score_docs) WHERE q = 1", "score_docs")
def _(i):
    return newest(i.score_docs.select("postcode", "data_version", "doc_no", "created_on", "tie2", "tie3", "price"), ["postcode", "data_version"], ["created_on", "doc_no", "tie2", "tie3", "price"]).select("postcode", "data_version", "doc_no", "price")


@query("win_stratified_split", """WITH h AS (SELECT conv_id, turn, role, md5('42-' || conv_id || '-' || turn) AS h FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY h) AS k, count(*) OVER (PARTITION BY role) AS n FROM h)
  SELECT conv_id, turn, role, CASE WHEN k <= greatest(1, round(n * 0.16)) THEN 'test_anchor' WHEN k <= greatest(1, round(n * 0.16)) + greatest(1, round(n * 0.24)) THEN 'test_query' ELSE 'train' END AS split FROM r""")
def _(i):
    # hash order is the seeded shuffle; the place in it comes from slab totals, not from sorting a stratum
    h = F.md5(F.concat_ws("-", F.lit("42"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    turns = i.table("conversations")
    digits = max(2, math.ceil(math.log(max(1, turns.count() / 4096), 16)))  # slabs of a few thousand rows, whatever the table
    rows = turns.select("conv_id", "turn", "role", h.alias("h")).withColumn("slab", F.substring("h", 1, digits))
    slabs = rows.groupBy("role", "slab").agg(F.count(F.lit(1)).alias("c"))
    across = W.partitionBy("role")
    slabs = slabs.select("role", "slab", F.sum("c").over(across).alias("n"), (F.sum("c").over(across.orderBy("slab")) - F.col("c")).alias("base"))
    k = F.col("base") + F.row_number().over(W.partitionBy("role", "slab").orderBy("h"))
    a, q = F.greatest(F.lit(1.0), F.round(F.col("n") * 0.16)), F.greatest(F.lit(1.0), F.round(F.col("n") * 0.24))
    split = F.when(F.col("k") <= a, "test_anchor").when(F.col("k") <= a + q, "test_query").otherwise("train")
    return rows.join(slabs, ["role", "slab"]).withColumn("k", k).select("conv_id", "turn", "role", split.alias("split"))


@query("topk_pending", """WITH p AS (SELECT id AS property_id, date_listed FROM listings WHERE delisted_date IS NULL AND NOT EXISTS (SELECT 1 FROM plans f WHERE f.id = listings.id AND f.ok = 1)), t AS (SELECT property_id FROM p ORDER BY date_listed DESC NULLS LAST, property_id LIMIT 50)
  SELECT property_id, image_no, tie3 FROM images WHERE property_id IN (SELECT property_id FROM t)""", "listings plans images")
def _(i):
    pending = i.listings.where("delisted_date IS NULL").join(i.plans.where("ok = 1").select("id"), "id", "left_anti")
    top = pending.orderBy(F.desc_nulls_last("date_listed"), "id").limit(50).select(F.col("id").alias("property_id"))
    return i.images.join(top, "property_id", "left_semi").select("property_id", "image_no", "tie3")


@query("topk_audit_sample", "SELECT msg_id FROM chats WHERE trim(assistant_text) <> '' ORDER BY CASE WHEN assistant_text LIKE '%data%' THEN 0 ELSE 1 END, msg_id LIMIT 20", "chats")
def _(i):
    rich = F.when(F.col("assistant_text").contains("data"), 0).otherwise(1)
    return i.chats.where(F.trim("assistant_text") != "").orderBy(rich, "msg_id").limit(20).select("msg_id")


@query("set_exclude_used", """SELECT id FROM (SELECT id, md5('20260902-' || id) AS h FROM listings WHERE delisted_date IS NULL AND NOT EXISTS (SELECT 1 FROM plans f WHERE f.id = listings.id)) x ORDER BY h LIMIT 40""", "listings plans")
def _(i):
    pool = i.listings.where("delisted_date IS NULL").join(i.plans.select("id"), "id", "left_anti")
    return pool.orderBy(F.md5(F.concat(F.lit("20260902-"), F.col("id").cast("string")))).limit(40).select("id")


# Four users are a site: a lead, one whose alert the lead's stands for, and two others; every fifth site could not be read.
@query("set_down_hosts", f"""WITH h AS (SELECT user_id AS host, user_id // 4 AS site, least(user_id % 4, 2) AS role, 43200 + 7200 * (user_id % 3) AS budget, {AT} - max(at_s) FILTER (WHERE at_s <= {AT}) AS age, {AT} - 86400 - max(at_s) FILTER (WHERE at_s <= {AT} - 86400) AS then_age, (user_id // 4) % 5 <> 0 AS reachable FROM runs GROUP BY user_id),
  s AS (SELECT *, coalesce(age > budget, true) AS stale, coalesce(then_age > budget, true) AS was_down FROM h), d AS (SELECT *, CASE WHEN role = 0 THEN NOT reachable OR stale WHEN NOT reachable THEN was_down ELSE stale END AS down FROM s)
  SELECT host, CASE WHEN down THEN 'down' ELSE 'up' END AS alert FROM (SELECT *, bool_or(role = 0 AND down) OVER (PARTITION BY site) AS dark FROM d) x WHERE down <> was_down AND NOT (dark AND role = 1)""", "runs")
def _(i):
    user = F.col("user_id")
    last = lambda at: at - F.max(F.when(F.col("at_s") <= at, F.col("at_s")))
    h = i.runs.groupBy("user_id").agg(last(AT).alias("age_s"), last(AT - 86400).alias("then_s"))
    budget = 43200 + 7200 * (user % 3)
    site = F.floor(user / 4)
    hosts = h.select(user.alias("host"), site.alias("site"), F.least(user % 4, F.lit(2)).alias("role"), "age_s", budget.alias("budget_s"), F.coalesce(F.col("then_s") > budget, F.lit(True)).alias("was_down"), (site % 5 != 0).alias("reachable"))
    return op.host_alerts(hosts)


_LBL = "SELECT id, room_no, room_type, label, area_sqft, sum(CASE WHEN room_type NOT IN ('balcony', 'terrace', 'garden') THEN round(area_sqft)::BIGINT END) OVER (PARTITION BY id) AS indoor, (SELECT floor_area_sqft FROM listings l WHERE l.id = rooms.id) AS gia FROM rooms"


@query("room_areas", f"""WITH r AS ({_LBL}) SELECT id, room_no, label, CASE WHEN room_type = 'balcony' AND gia > 0 AND area_sqft > gia THEN NULL WHEN room_type IN ('balcony', 'terrace', 'garden') OR gia IS NULL OR gia <= 0 OR indoor <= gia THEN round(area_sqft) ELSE round(round(area_sqft) * gia / indoor) END AS area FROM r""", "rooms listings")
def _(i):
    # the indoor sum is an aggregate joined back, so a listing's rooms are never gathered
    outdoor = lab.outdoor_kind(F.col("room_type"), F.col("label"))
    rooms = i.rooms.withColumn("out", outdoor).withColumn("a", F.round("area_sqft"))
    sums = rooms.groupBy("id").agg(F.sum(F.when(F.col("out").isNull(), F.col("a").cast("bigint"))).alias("indoor"))
    j = rooms.join(sums, "id").join(i.listings.select("id", F.col("floor_area_sqft").alias("gia")), "id", "left")
    over = F.coalesce((F.col("gia") > 0) & (F.col("indoor") > F.col("gia")), F.lit(False))
    area = F.when((F.col("out") == "balcony") & (F.col("gia") > 0) & (F.col("area_sqft") > F.col("gia")), F.lit(None)).when(F.col("out").isNull() & over, F.round(F.col("a") * F.col("gia") / F.col("indoor"))).otherwise(F.col("a"))
    return j.select("id", "room_no", "label", area.alias("area"))


# Which types make up each count; words in a label that rule a bedroom out.
COUNTED = {
    "bathrooms": ("bathroom", "shower_room"), "receptions": ("living", "dining", "reception"),
    "rooms": ("bedroom", "bathroom", "shower_room", "wc", "kitchen", "living", "dining", "reception", "study", "utility", "storage"),
}
NOT_BEDROOM = r"\b(living|lounge|sitting|reception|study|office|kitchen|dining|hall|bath|shower|wc|utility|storage|garage|garden)\b"


@query("room_counts", "SELECT id, count(*) FILTER (WHERE room_type = 'bedroom' AND label IN ('Bedroom 1', 'Master Bedroom', 'Bed 2')) AS bedrooms, " + ", ".join(f"count(*) FILTER (WHERE room_type IN {types}) AS {name}" for name, types in COUNTED.items()) + " FROM plan_rooms GROUP BY id", "plan_rooms")
def _(i):
    # counts come as a JSON document per listing, either plain numbers or {count: n}
    per = i.plan_rooms.groupBy("id", "room_type").agg(F.count(F.lit(1)).alias("c"))
    doc = per.groupBy("id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("room_type", F.when(F.col("c") % 2 == 0, F.to_json(F.struct(F.col("c").alias("count")))).otherwise(F.col("c").cast("string")))))).alias("counts"))
    raw = F.from_json("counts", "map<string,string>")
    n = lambda t: F.coalesce(F.get_json_object(F.try_element_at(raw, F.lit(t)), "$.count").cast("bigint"), F.try_element_at(raw, F.lit(t)).try_cast("bigint"), F.lit(0))
    # bedrooms are counted by their labels where a plan has labels, else taken from the document
    bed = F.col("room_type") == "bedroom"
    audited = i.plan_rooms.groupBy("id").agg(F.count("label").alias("labels"), F.count_if(bed & ~F.coalesce(F.lower("label").rlike(NOT_BEDROOM), F.lit(False))).alias("audited"))
    bedrooms = F.when(F.col("labels") > 0, F.col("audited")).otherwise(n("bedroom"))
    sums = [sum((n(t) for t in types[1:]), n(types[0])).alias(name) for name, types in COUNTED.items()]
    return doc.join(audited, "id").select("id", bedrooms.alias("bedrooms"), *sums)


@query("udtf_room_labels", "SELECT room_type, count(*) AS n, min(pos) AS first_pos FROM (SELECT id, room_type, row_number() OVER (PARTITION BY id ORDER BY room_type) - 1 AS pos FROM (SELECT DISTINCT id, room_type FROM rooms)) t GROUP BY room_type", "rooms")
def _(i):
    lists = i.rooms.groupBy("id").agg(F.array_sort(F.collect_set("room_type")).alias("types"))
    rows = lists.select("id", F.posexplode("types").alias("pos", "room_type"))
    return rows.groupBy("room_type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query("udaf_upper_median", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, max(n) AS n, max(l_extendedprice) FILTER (WHERE k = n // 2 + 1) AS mid FROM o GROUP BY l_suppkey")
def _(i):
    return group_quantiles(i.table("lineitem"), ["l_suppkey"], "l_extendedprice", {"mid": "upper"})


@query("udaf_index_percentile", "WITH o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, max(value) FILTER (WHERE k = least(floor(n * 0.1), n - 1)) AS p10, max(value) FILTER (WHERE k = least(floor(n * 0.99), n - 1)) AS p99 FROM o GROUP BY event_type")
def _(i):
    return group_quantiles(i.table("events"), ["event_type"], "value", {"p10": ("index", 0.1), "p99": ("index", 0.99)})
