"""The live detector over deliveries in any order, against plain folds over the rows that were in time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import stream_queries
from tidemark.streaming import live

T0 = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, id long, token string, label string, score double"


def deliver(spark, path, files):
    """Each list of (key, minute, id, score) is a file, and so a batch; names keep their order."""
    for i, rows in enumerate(files):
        made = [(k, T0 + timedelta(minutes=m), n, f"t{n}", "benign", s) for k, m, n, s in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return live.event_stream(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, "60 minutes", per_batch=1)


FAR = [("z", 100_000, 999, 1.0)]
FILES = [
    [("a", 30, 2, 20.0), ("a", 10, 1, 0.0), ("b", 0, 10, 5.0)],
    [("a", 20, 3, 5.0), ("a", 200, 6, 20.0), ("a", 150, 5, None)],  # 20 is before 30 of the first file, and in time
    [("a", 139, 7, 99.0), ("b", 130, 12, 3.0), ("a", 145, 4, 8.0), ("b", 300, 11, 7.0)],  # the watermark stands at 140
    FAR,
]


def fold(scores, t_op=10.0, t_min=1.0):
    u = c = t_op
    out = []
    for a in scores:
        out.append((u, c))
        if a is not None:
            c = max(t_min, 0.9 * c + 0.1 * a) if a <= c else c
            u = max(t_min, 0.9 * u + 0.1 * a)
    return out


@pytest.fixture
def rocks(spark):
    live.use_rocksdb(spark)
    return spark


def test_late_rows_move_nothing_and_are_counted(rocks, tmp_path):
    spark = rocks
    stream = live.policies(deliver(spark, tmp_path, FILES), 10.0, 1.0, slot=600_000)
    out = live.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state", stream.schema).cache()
    assert {r["key"]: r["n"] for r in live.late_by_key(out).collect()} == {"a": 1, "b": 1}
    assert {(r["key"], r["id"], r["score"]) for r in out.where("late").collect()} == {("a", 7, 99.0), ("b", 12, 3.0)}
    got = live.on_time(out).where("key = 'a'").orderBy("ts", "id").collect()
    assert [r["id"] for r in got] == [1, 3, 2, 4, 5, 6]
    scores = [0.0, 5.0, 20.0, 8.0, None, 20.0]
    assert [y for r in got for y in (r["t_uncond"], r["t_cond"])] == pytest.approx([y for x in fold(scores) for y in x])
    assert [r["f_fixed"] for r in got] == [False, False, True, False, False, True]


def test_windows_over_shuffled_deliveries(rocks, tmp_path):
    spark = rocks
    rows = [("a", m, m, 1.0) for m in range(120)]
    files = [[r for r in reversed(rows) if r[1] % 40 < 25 and r[1] // 40 == i or r[1] % 40 >= 25 and r[1] // 40 + 1 == i] for i in range(4)]
    windows = live.on_time(live.count_windows(deliver(spark, tmp_path, [*files, FAR]), length=10, stride=3, slot=60_000))
    got = live.drain(windows, f"{tmp_path}/out", f"{tmp_path}/state", windows.schema).orderBy("win_ix").collect()
    assert [(r["win_ix"], r["tokens"]) for r in got] == [(i, [f"t{m}" for m in range(3 * i, 3 * i + 10)]) for i in range(37)]
    assert [r["id"] for r in got] == [3 * i + 9 for i in range(37)]


def test_a_key_that_returns_after_its_state_ended(rocks, tmp_path):
    """Idle for 100 minutes: b returns after 300, when its state is gone, and within one batch a gap ends it as well."""
    spark = rocks
    files = [[("b", 0, 1, 0.0), ("b", 50, 2, 0.0)], [("c", 200, 90, 1.0)], [("b", 350, 3, 0.0), ("b", 351, 4, 0.0), ("b", 460, 5, 0.0)], FAR]
    stream = live.policies(deliver(spark, tmp_path, files), 10.0, 1.0, slot=600_000, idle=6000, warm_seconds=120)
    out = live.on_time(live.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state", stream.schema)).where("key = 'b'").orderBy("ts").collect()
    assert [(r["t_cond"], r["warm"]) for r in out] == [(10.0, True), (9.0, False), (10.0, True), (9.0, True), (10.0, True)]


def test_global_threshold_is_one_fold(rocks, tmp_path):
    spark = rocks
    files = [[(f"k{m % 5}", 100 * i + m, 100 * i + m, float((m * 7919 + i) % 23)) for m in range(90)] for i in range(3)]
    out = live.GlobalThreshold(str(tmp_path / "g"), 10.0, 1.0).run(deliver(spark, tmp_path, files), f"{tmp_path}/state")
    got = out.orderBy("ts").select("T_before").collect()
    assert [r[0] for r in got] == pytest.approx([x[0] for x in fold([r[3] for f in files for r in f])])
    # A batch that runs again starts from the T that it started from.
    again = live.GlobalThreshold(str(tmp_path / "g"), 10.0, 1.0)
    batch = spark.createDataFrame([(k, T0 + timedelta(minutes=m), n, f"t{n}", "benign", s) for k, m, n, s in files[1]], SCHEMA)
    again(batch, 1)
    assert sorted(r["T_before"] for r in spark.read.parquet(f"{tmp_path}/g/rows").collect()) == pytest.approx(sorted(r[0] for r in got))


def test_empty_stream(rocks, tmp_path):
    stream = live.policies(deliver(rocks, tmp_path, [FAR]), 10.0, 1.0)
    assert live.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state", stream.schema).count() == 0


def test_keys_of_several_columns(spark):
    rows = spark.createDataFrame([("a", "b,c"), ("a,b", "c"), (None, "c"), ("null", "c")], "namespace string, pod string")
    assert len({r["key"] for r in live.keyed(rows, "namespace", "pod").collect()}) == 4


def test_closing_row_passes_the_filter_on_tokens(spark):
    rows = spark.createDataFrame([("a", T0, 1, "signup", "benign", 1.0)], SCHEMA)
    assert stream_queries._closing(rows).first()["token"] in stream_queries.EVENTS


def test_state_is_kept_by_buckets(rocks, tmp_path):
    """3,000 keys leave a row for each bucket that keeps memory, not one or more for each key, and each key is its own fold."""
    spark = rocks
    files = [[(f"k{k}", 100 * i + k % 7, 3000 * i + k, float(k % 20)) for k in range(3000)] for i in range(2)]
    stream = live.policies(deliver(spark, tmp_path, [*files, FAR]), 10.0, 1.0, slot=600_000)
    q = live.run(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 1500
    out = live.on_time(spark.read.schema(stream.schema).parquet(f"{tmp_path}/out"))
    got = {(r["key"], r["id"]): (r["t_uncond"], r["t_cond"]) for r in out.collect()}
    assert len(got) == 6000
    for k in range(0, 3000, 7):
        want = fold([float(k % 20)] * 2)
        assert [x for i in range(2) for x in got[f"k{k}", 3000 * i + k]] == pytest.approx([x for w in want for x in w])


def test_idle_waits_for_rows_of_the_slot_that_the_watermark_stands_in(rocks, tmp_path):
    """The watermark stands at 115 in the slot from 60 to 120: b's row at 65, 15 minutes after its last, still waits."""
    spark = rocks
    files = [[("b", 50, 1, 0.0), ("b", 65, 2, 0.0)], [("c", 175, 90, 1.0)], FAR]
    stream = live.policies(deliver(spark, tmp_path, files), 10.0, 1.0, slot=3_600_000, idle=1200)
    out = live.on_time(live.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state", stream.schema)).where("key = 'b'").orderBy("ts").collect()
    assert [r["t_cond"] for r in out] == [10.0, 9.0]


def test_threshold_rise_by_hand(rocks, tmp_path):
    """All sliding hours of a key once, over batches and silences, with state by bucket and not by window."""
    spark = rocks
    files = [[("a", 0, 1, 5.0), ("a", 25, 2, 9.0), ("b", 7, 3, 1.0)], [("a", 84, 4, None), ("a", 90, 5, 2.0)], [("a", 400, 6, 3.0), ("b", 401, 7, 1.0)], FAR]
    stream = live.threshold_rise(deliver(spark, tmp_path, files).withColumnRenamed("score", "t"), 3.5, slot=600_000)
    out = live.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state", stream.schema)
    got = sorted((r["key"], int((r["start"] - T0).total_seconds() // 60), r["rise"], r["abnormal"]) for r in out.where("key <> 'z'").collect())
    rows = [(k, m, s) for f in files[:3] for k, m, _, s in f]
    want = []
    for k in "ab":
        for start in range(-60, 500, 10):
            held = [(m, s) for x, m, s in rows if x == k and start <= m < start + 60]
            t = [s for _, s in held if s is not None]
            if held:
                rise = max(t) - min(t) if t else None
                want.append((k, start, rise, rise > 3.5 if t else None))
    assert got == sorted(want)


def test_large_slices_are_written_by_several_tasks(spark, monkeypatch):
    """Each slice as the same number of files, and a slice is a micro-batch; the closing row is one of its own."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 200)
    rows = spark.range(6000).select(F.lit("a").alias("key"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), "id", F.lit(2.0).alias("score"))
    stream, seen = stream_queries._stream(spark, rows, {}), []
    stream = stream.withColumn("f", F.input_file_name())
    q = stream.writeStream.foreachBatch(lambda b, i: seen.append(tuple(b.agg(F.countDistinct("f"), F.count("*"), F.min("id")).first()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 6 and len({x[0] for x in seen[:5]}) == 1 and seen[0][0] in (5, 6)
    assert sorted(seen[:5], key=lambda x: x[2]) == seen[:5] and all(a[2] + a[1] == b[2] for a, b in zip(seen, seen[1:5], strict=False))
    assert sum(x[1] for x in seen[:5]) == 6000 and seen[5][1] == 1
