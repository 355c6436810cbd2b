"""Sessions end when a gap of the full length has passed."""

import uuid

from hearthspan.streaming import jobs


def test_a_row_exactly_the_gap_later_begins_a_session(spark, tmp_path):
    rows = spark.sql("SELECT id AS user_id, timestamp_seconds(at_s) AS started_at FROM VALUES (1L, 0L), (1L, 7199L), (1L, 14399L), (9L, 900000L) AS t(id, at_s)")
    folder = str(tmp_path / uuid.uuid4().hex)
    rows.write.parquet(folder)
    out = jobs.run_and_read(jobs.sessions(jobs.read_folder(spark, folder, rows.schema), "2 hours", "user_id", "1 hour"), "append")
    got = out.where("user_id = 1").selectExpr("unix_seconds(start)", "unix_seconds(end)", "n").collect()
    assert sorted(map(tuple, got)) == [(0, 14399, 2), (14399, 21599, 1)]
