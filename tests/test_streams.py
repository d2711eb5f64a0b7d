"""Streaming jobs over several files give what one batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from shortlist.streaming import jobs


def arrivals(spark, path, df, files):
    df.repartition(files).write.parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_bounded_sample_ignores_batching(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "item")
    one = jobs.bounded_sample(arrivals(spark, tmp_path / "a", df, 1), 20, "s", "item")
    many = jobs.bounded_sample(arrivals(spark, tmp_path / "b", df, 4), 20, "s", "item")
    assert sorted(r["item"] for r in one.collect()) == sorted(r["item"] for r in many.collect())
    assert {r["stream_length"] for r in many.collect()} == {300}


def test_incremental_judging_keeps_state_between_rounds(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", 1, i, f"r{i % 6}", f"c{i % 3}" if i % 6 else None) for i in range(12)],
        "run string, query_id long, draw long, raw string, canonical string",
    ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("draw")))
    path = str(tmp_path / "rounds")
    for lo, hi in ((0, 5), (5, 12)):
        rows.filter((F.col("draw") >= lo) & (F.col("draw") < hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.run_to_end(jobs.incremental_judging(stream, k=3, cap=20), "t")
    got = [(r["raw"], r["duplicate"], r["n_filled"], r["wants_more"]) for r in out.orderBy("draw").collect()]
    assert got == [
        ("r0", False, 0, True), ("r1", False, 1, True), ("r2", False, 2, True),
        ("r3", False, 3, False), ("r4", True, 3, False), ("r5", True, 3, False),
    ]


def one_by_one(rows, k, cap, strings=False):
    """The same judging over all draws of a query in a plain loop."""
    out = []
    for query in sorted({r[1] for r in rows}):
        raws, items, drawn, filled = set(), set(), 0, 0
        for _, q, draw, raw, canonical in sorted((r for r in rows if r[1] == query), key=lambda r: r[2]):
            drawn += 1
            if raw in raws:
                continue
            raws.add(raw)
            repeat = canonical is not None and canonical in items
            items.add(canonical)
            filled += (canonical is not None and not repeat) or (strings and canonical is None)
            out.append((q, draw, raw, canonical, repeat, filled, filled < k and drawn < cap))
    return out


def test_judging_stopped_and_resumed_equals_one_pass(spark, tmp_path):
    import random

    rng = random.Random(6)
    rows = [
        ("a", q, d, None if (d * q) % 31 == 7 else f"r{rng.randint(0, 40)}", rng.choice([None, *(f"c{i}" for i in range(15))]))
        for q, n in ((1, 400), (2, 7), (3, 1), (4, 60))
        for d in range(n)
    ]
    schema = "run string, query_id long, draw long, raw string, canonical string"
    path = str(tmp_path / "in")
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("draw")))
    read = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for budget in ("molecules", "strings"):
        folder = str(tmp_path / budget)
        for lo, hi in ((0, 30), (30, 33), (33, 500)):
            part = whole.filter((F.col("draw") >= lo) & (F.col("draw") < hi))
            if budget == "molecules":
                part.coalesce(1).write.mode("append").parquet(path)
            out = jobs.run_to_end(jobs.incremental_judging(read(), k=9, cap=50, budget=budget), "t", folder=folder)
        got = [tuple(r)[1:] for r in out.collect()]
        assert sorted(got, key=lambda r: r[:2]) == one_by_one(rows, 9, 50, budget == "strings")


def test_idle_state_expires(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "run string, query_id long, draw long, raw string, canonical string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    hour = 3600
    # the second round pushes the watermark past the first query's timer; its strings are new again
    for at, q in ((0, 1), (5 * hour, 2), (5 * hour + 60, 2), (6 * hour, 1)):
        row = spark.createDataFrame([("a", q, at, "x", "c")], "run string, query_id long, draw long, raw string, canonical string")
        row.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + at))).coalesce(1).write.mode("append").parquet(path)
        out = jobs.run_to_end(jobs.incremental_judging(read(), k=3, cap=9), "t", folder=folder)
    assert sorted((r.query_id, r.draw) for r in out.collect()) == [(1, 0), (1, 6 * hour), (2, 5 * hour)]


def test_jobs_go_on_where_they_stopped(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for lo, hi in ((0, 100), (100, 300)):
        spark.range(lo, hi).withColumnRenamed("id", "item").coalesce(1).write.mode("append").parquet(path)
        stream = lambda: spark.readStream.schema("item long").option("maxFilesPerTrigger", 1).parquet(path)
        sample = jobs.bounded_sample(stream(), 20, "s", "item", folder=str(tmp_path / "sample"))
        seen.append({r["stream_length"] for r in sample.collect()})
        table = jobs.run_to_end(stream(), "t", folder=str(tmp_path / "table"))
        assert table.count() == hi
    assert seen == [{100}, {300}]
    again = jobs.bounded_sample(stream(), 20, "s", "item", folder=str(tmp_path / "sample"))
    whole = jobs.bounded_sample(stream(), 20, "s", "item")
    assert {r["item"] for r in again.collect()} == {r["item"] for r in whole.collect()}


def test_missing_earlier_sample_is_an_error(spark, tmp_path):
    import shutil

    import pytest

    path, folder = str(tmp_path / "in"), str(tmp_path / "sample")
    read = lambda: spark.readStream.schema("item long").parquet(path)
    spark.range(10).withColumnRenamed("id", "item").write.parquet(path)
    jobs.bounded_sample(read(), 5, "s", "item", folder=folder)
    shutil.rmtree(f"{folder}/out/batch=0")
    spark.range(10, 20).withColumnRenamed("id", "item").write.mode("append").parquet(path)
    with pytest.raises(Exception, match="missing"):
        jobs.bounded_sample(read(), 5, "s", "item", folder=folder)
