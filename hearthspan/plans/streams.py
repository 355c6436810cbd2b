"""Streaming queries: the run log replayed as files that arrive in time order."""

from pyspark.sql import functions as F

from hearthspan.plans.base import query
from hearthspan.plans.monitor import AT
from hearthspan.session import scratch
from hearthspan.streaming import jobs, stateful

LATE = "1 day"
CUTS = (1704672000, 1705276800, 1705881600)  # 8, 15 and 22 January 2024


FILES = 8


def arrive(df, path, slices=range(len(CUTS) + 1)):
    """One writer a time slice, each appending many files to a folder."""
    bounds = [-1, *CUTS, 1 << 60]

    def write(n):
        return lambda: df.where((F.col("at_s") > bounds[n]) & (F.col("at_s") <= bounds[n + 1])).repartition(FILES).write.mode("append").parquet(path)

    return [write(n) for n in slices]


def stream(i, df, name="runs"):
    """The frame over a folder, and the arrivals to come."""
    path = scratch(i.spark, name)
    df.limit(0).write.parquet(path)
    return jobs.read_folder(i.spark, path, df.schema), arrive(df, path)


def slim(i, *extra):
    return i.runs.select("run_id", "started_at", "at_s", "user_id", "job", "status", "latency", *extra)


@query("stream_incremental_claim", f"SELECT run_no, count(*) AS n, max(run_id) AS last_run FROM (SELECT run_id, CASE WHEN at_s <= {CUTS[1]} THEN 1 ELSE 2 END AS run_no FROM runs) t GROUP BY run_no", "runs")
def _(i):
    df = slim(i)
    path = scratch(i.spark, "claim")
    counts = []
    for n, slices in ((1, (0, 1)), (2, (2, 3))):
        for step in arrive(df, f"{path}/in", slices):
            step()
        jobs.run(jobs.read_folder(i.spark, f"{path}/in", df.schema), "append", f"{path}/run={n}", f"{path}/checkpoint")
        counts.append(i.spark.read.parquet(f"{path}/run={n}").withColumn("run_no", F.lit(n)))
    return counts[0].unionByName(counts[1]).groupBy("run_no").agg(F.count(F.lit(1)).alias("n"), F.max("run_id").alias("last_run"))


@query("stream_late_overlap", "SELECT job, count(*) AS n, sum(run_id)::BIGINT AS id_sum FROM runs GROUP BY job", "runs")
def _(i):
    # every slice is read again together with its successor's first day
    df = slim(i)
    again = df.where(" OR ".join(f"(at_s > {c - 86400} AND at_s <= {c})" for c in CUTS)).withColumn("at_s", F.col("at_s") + 86400)
    rows, steps = stream(i, df.unionByName(again))
    return jobs.run_and_read(jobs.late_overlap(rows, ["run_id"], "3 days"), "append", arrivals=steps).groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sum("run_id").alias("id_sum"))


@query("stream_throughput_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 MINUTE, started_at), '%Y-%m-%d %H:%M') AS start, job, count(*) AS n FROM runs GROUP BY ALL", "runs")
def _(i):
    rows, steps = stream(i, slim(i))
    out = jobs.tumbling(rows, "1 minute", "job", LATE)
    return jobs.run_and_read(out, "update", ["start", "job"], steps).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("stream_throughput_sliding", "SELECT strftime(time_bucket(INTERVAL 1 MINUTE, started_at) - to_minutes(k), '%Y-%m-%d %H:%M') AS start, job, count(*) AS n FROM runs, (SELECT unnest(range(10)) AS k) g GROUP BY ALL", "runs")
def _(i):
    rows, steps = stream(i, slim(i))
    out = jobs.sliding(rows, "10 minutes", "1 minute", "job", LATE)
    return jobs.run_and_read(out, "update", ["start", "job"], steps).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("stream_sessions", """WITH g AS (SELECT user_id, at_s, CASE WHEN at_s - lag(at_s) OVER w < 7200 THEN 0 ELSE 1 END AS is_new FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY at_s)), s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY at_s ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(at_s) AS start_s, count(*) AS n FROM s GROUP BY user_id, k""", "runs")
def _(i):
    # whole seconds on both sides; a row far ahead closes the last sessions and is not a session itself
    df = slim(i).withColumn("started_at", F.timestamp_seconds("at_s"))
    flush = df.limit(1).withColumn("user_id", F.lit(-1).cast("bigint")).withColumn("at_s", F.lit(4102444800).cast("bigint")).withColumn("started_at", F.timestamp_seconds(F.lit(4102444800)))
    rows, steps = stream(i, df.unionByName(flush))
    return jobs.run_and_read(jobs.sessions(rows, "2 hours", "user_id", LATE), "append", arrivals=steps).where("user_id >= 0").select("user_id", F.unix_seconds("start").alias("start_s"), "n")


@query("stream_latest_snapshot", "SELECT user_id, run_id, job, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_s DESC, run_id DESC) AS q FROM runs) WHERE q = 1", "runs")
def _(i):
    rows, steps = stream(i, slim(i))
    return jobs.snapshot(rows, ["user_id"], ["at_s", "run_id"], steps).select("user_id", "run_id", "job", "status")


def ending(df, key):
    """The frame and one row of another key far ahead, whose watermark lets everything before it be judged."""
    return df.unionByName(df.limit(1).withColumn(key, F.lit(-1).cast("long")).withColumn("at_s", F.lit(4102444800).cast("long")))


# Four users are a site: its lead, one whose alerts the lead's replace and two that are seen through it; each host has its own budget.
_OUT = """h AS (SELECT user_id // 4 AS site, user_id AS host, least(user_id % 4, 2) AS role, 43200 + 7200 * (user_id % 3) AS budget, at_s FROM runs),
 g AS (SELECT *, lead(at_s) OVER (PARTITION BY host ORDER BY at_s) AS next_s FROM h), o AS (SELECT site, host, role, at_s + budget AS d, coalesce(next_s, 1152921504606846976) AS u FROM g WHERE coalesce(next_s, 1152921504606846976) - at_s > budget),
 t AS (SELECT site, d AS at_s FROM o UNION SELECT site, u FROM o WHERE u < 1152921504606846976 UNION SELECT site, min(at_s) FROM h GROUP BY site, host),
 s AS (SELECT t.site, t.at_s, a.host, a.role, EXISTS (SELECT 1 FROM o WHERE o.host = a.host AND o.d <= t.at_s AND t.at_s < o.u) AS own, EXISTS (SELECT 1 FROM o WHERE o.site = t.site AND o.role = 0 AND o.d <= t.at_s AND t.at_s < o.u) AS dark
   FROM t JOIN (SELECT DISTINCT site, host, role FROM h) a ON a.site = t.site),
 v AS (SELECT *, CASE WHEN dark AND role = 1 THEN false WHEN dark AND role = 2 THEN coalesce(last_value(CASE WHEN NOT dark THEN own END IGNORE NULLS) OVER w, false) ELSE own END AS shown FROM s WINDOW w AS (PARTITION BY host ORDER BY at_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 x AS (SELECT *, coalesce(lag(shown) OVER (PARTITION BY host ORDER BY at_s), false) AS before FROM v)"""


@query("stream_heartbeat", f"WITH {_OUT} SELECT host, at_s, CASE WHEN shown THEN 'down' ELSE 'up' END AS state FROM x WHERE shown <> before AND NOT (dark AND role = 1)", "runs")
def _(i):
    user = F.col("user_id")
    d = i.runs.select(F.floor(user / 4).cast("long").alias("site"), user.alias("host"), F.least(user % 4, F.lit(2)).cast("int").alias("role"), (43200 + 7200 * (user % 3)).cast("long").alias("budget"), "at_s")
    rows, steps = stream(i, ending(d, "site"))
    with stateful.rocksdb(i.spark):
        return jobs.run_and_read(stateful.heartbeat(rows, "site", "0 seconds"), "append", arrivals=steps).where("site >= 0").select("host", "at_s", "state")


_PER = "per AS (SELECT queue_no, at_s // 21600 AS period, count(*) FILTER (WHERE error_message = 'database is locked') AS failures FROM runs GROUP BY ALL), cl AS (SELECT * FROM per WHERE period < (SELECT max(period) FROM per x WHERE x.queue_no = per.queue_no))"


@query("stream_alert_state", f"""WITH {_PER}, i AS (SELECT *, sum(CASE WHEN failures = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY queue_no ORDER BY period) AS isl FROM cl), s AS (SELECT *, CASE WHEN failures = 0 THEN 0 ELSE row_number() OVER (PARTITION BY queue_no, isl ORDER BY period) - CASE WHEN isl > 0 THEN 1 ELSE 0 END END AS streak FROM i),
  p AS (SELECT *, failures >= 8 OR streak >= 3 AS problem FROM s) SELECT queue_no, period, failures, streak, CASE WHEN problem AND NOT coalesce(lag(problem) OVER w, false) THEN 'onset' WHEN NOT problem AND lag(problem) OVER w THEN 'clear' END AS edge FROM p WINDOW w AS (PARTITION BY queue_no ORDER BY period)""", "runs")
def _(i):
    df = i.runs.select("queue_no", "at_s", F.coalesce((F.col("error_message") == "database is locked").cast("long"), F.lit(0).cast("long")).alias("failed"))
    rows, steps = stream(i, df)
    return jobs.run_and_read(jobs.alert_state(rows, "queue_no", 21600, 8, 3), "append", arrivals=steps)


@query("stream_stall_counter", """WITH t AS (SELECT queue_no, at_s // 3600 * 3600 AS at_s, max(run_id) AS size_n, max(run_id) // 300 AS done_n FROM runs GROUP BY 1, 2), p AS (SELECT *, lag(size_n) OVER w AS s0, lag(done_n) OVER w AS d0 FROM t WINDOW w AS (PARTITION BY queue_no ORDER BY at_s)),
  r AS (SELECT *, sum(CASE WHEN s0 IS NULL OR size_n < s0 OR done_n <> d0 THEN 1 ELSE 0 END) OVER (PARTITION BY queue_no ORDER BY at_s) AS part, CASE WHEN size_n - s0 >= 10 AND done_n = d0 THEN 1 ELSE 0 END AS grew FROM p)
  SELECT queue_no, at_s, sum(grew) OVER (PARTITION BY queue_no, part ORDER BY at_s)::BIGINT AS stalled FROM r""", "runs")
def _(i):
    hour = F.floor(F.col("at_s") / 3600)
    t = i.runs.groupBy("queue_no", hour.alias("h")).agg(F.max("run_id").alias("size_n"), (F.floor(F.max("run_id") / 300)).alias("done_n"))
    rows, steps = stream(i, ending(t.select("queue_no", (F.col("h") * 3600).alias("at_s"), "size_n", "done_n"), "queue_no"))
    with stateful.rocksdb(i.spark):
        return jobs.run_and_read(stateful.stall_counter(rows, "queue_no", 10), "append", arrivals=steps).where("queue_no >= 0")


@query("stream_spend_bucket", "WITH d AS (SELECT strftime(started_at, '%Y-%m-%d') AS day, floor(sum(round(latency * 100)::BIGINT) / 100 / 3000)::BIGINT AS top FROM runs GROUP BY 1) SELECT day, unnest(generate_series(1, top)) AS bucket FROM d WHERE top >= 1", "runs")
def _(i):
    day = F.date_trunc("day", "started_at")
    cents = F.sum(F.round(F.col("latency") * 100).cast("bigint"))
    rows, steps = stream(i, slim(i))
    out = rows.withWatermark("started_at", LATE).groupBy(day.alias("day")).agg(cents.alias("cents"))
    last = jobs.run_and_read(out, "update", ["day"], steps).withColumn("top", F.floor(F.col("cents") / 100 / 3000)).where("top >= 1")
    return last.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("top"))).alias("bucket"))


@query("stream_fix_budget", """WITH RECURSIVE t AS (SELECT queue_no, at_s // 1800 * 1800 AS at_s, max(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS faulty FROM runs GROUP BY 1, 2), k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY queue_no ORDER BY at_s) AS no FROM t),
  f(queue_no, no, at_s, fixed, last, verdict) AS (SELECT queue_no, 0::BIGINT, 0::BIGINT, -100000::BIGINT, '', '' FROM (SELECT DISTINCT queue_no FROM k)
   UNION ALL SELECT k.queue_no, k.no, k.at_s, CASE WHEN k.faulty = 1 AND f.fixed < k.at_s - 5400 THEN k.at_s ELSE f.fixed END, CASE WHEN k.faulty = 1 AND f.fixed < k.at_s - 5400 THEN 'fix' WHEN k.faulty = 1 THEN 'escalate' ELSE '' END,
    CASE WHEN k.faulty = 1 AND f.fixed < k.at_s - 5400 THEN 'fix' WHEN k.faulty = 1 AND f.last <> 'escalate' THEN 'escalate' WHEN k.faulty = 0 AND f.last = 'fix' THEN 'recover' WHEN k.faulty = 0 AND f.last = 'escalate' THEN 'recover-after-escalation' ELSE '' END
   FROM f JOIN k ON k.queue_no = f.queue_no AND k.no = f.no + 1)
  SELECT queue_no, at_s, verdict FROM f WHERE verdict <> ''""", "runs")
def _(i):
    half = F.floor(F.col("at_s") / 1800) * 1800
    t = i.runs.groupBy("queue_no", half.alias("at_s")).agg(F.max((F.col("status") == "failed").cast("int")).alias("faulty"))
    rows, steps = stream(i, ending(t, "queue_no"))
    with stateful.rocksdb(i.spark):
        return jobs.run_and_read(stateful.fix_budget(rows, "queue_no", 5400, 1), "append", arrivals=steps).where("queue_no >= 0")


@query("stream_backoff_claim", f"""SELECT property_id, image_no, tie3 FROM images i WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = i.property_id AND (r.status = 'completed' OR (r.status = 'failed' AND r.at_s > {AT} - 2160000)))""", "images runs")
def _(i):
    items = i.images.select("property_id", "image_no", "tie3", (F.col("image_no") * 0 + F.col("tie3") * 8640 + 1704067200).alias("at_s"))
    ok = F.when(F.col("status") == "completed", 1).when(F.col("status") == "failed", 0)
    results = i.runs.select(F.col("run_id").alias("property_id"), ok.alias("ok"), F.col("at_s").alias("done_s")).where("ok IS NOT NULL")
    rows, steps = stream(i, items, "items")
    return jobs.backoff_claim(rows, results, AT, 2160000, arrivals=steps).select("property_id", "image_no", "tie3")
