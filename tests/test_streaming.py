"""The stream of sessions against the table's, with late rows and a restart."""

import datetime as dt
import random

from quern.streaming import changes

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_stream_of_changes_equals_the_table(spark, tmp_path):
    for k, v in changes.STATE_STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), at(rng.randrange(0, 900)), rng.choice("ab")) for i in range(60)]
    rows.sort(key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(0, 100)))  # out of order, within the two hours
    odd = [(900, None, at(1), "a"), (901, 1, None, "a"), (902, 1, at(3), None)]
    late = [(950, 0, at(2), "b")]  # hours behind the watermark
    far = [(990 + u, u, at(5000), "z") for u in range(3)]
    last = [(999, 9, at(9000), "z")]  # lets the watermark pass the others
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for n, part in enumerate([rows[:20] + odd, rows[20:40], rows[40:], far, late, last]):  # each run goes on from the log
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = changes.change_sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    known = spark.createDataFrame(rows + odd + far + last, SCHEMA)
    want = {tuple(r) for r in changes.change_sessions(known).collect() if r.user_id != 9}
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[5] for r in got) == 63


def test_tables_without_rows(spark):
    assert changes.change_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
