"""State over batches, and a sink that publishes all or nothing."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ratchet
from lodestone.sources import atomic
from lodestone.streaming import stateful

FINDING = "k string, ord long, note string"


def streamed(spark, tmp_path, name, batches, schema, start):
    """Batches as files, one a batch, through `start`; the rows of the output."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        (spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i}")))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        query = start(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp"))
        query.awaitTermination(180)
        assert query.exception() is None
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / f"{name}-out")).collect()), key=str)


def test_ratchet_budgets_live_over_batches(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "hot", "hot", None, "new"]), i, f"n{i}") for i in range(60)]
    base = spark.createDataFrame([("a", 0), ("hot", 0), ("hot", 1), ("hot", 2), (None, 3), (None, 4)], "k string, ord long")
    start = lambda s, out, cp: stateful.ratchet_stream(s, base, ["k"], "ord", out, cp)
    want = sorted((tuple(x) for x in ratchet.multiset(spark.createDataFrame(rows, FINDING), base, ["k"], "ord").collect()), key=str)
    assert streamed(spark, tmp_path, "two", [rows[:23], rows[23:]], FINDING, start) == want
    assert sum(x[-1] for x in want) == 6


def test_clone_classes_live_over_batches(spark, tmp_path):
    rows = [(f"p{i % 5}", f"s{i // 10}", i) for i in range(40)] + [("once", "s9", 1)]
    schema = "passage string, stream string, start long"
    one = streamed(spark, tmp_path, "one", [rows], schema, stateful.clone_stream)
    two = streamed(spark, tmp_path, "two", [rows[:20], rows[20:]], schema, stateful.clone_stream)
    assert one == two
    firsts = {p: min((s, i) for q, s, i in rows if q == p) for p, _, _ in rows}
    assert all(x[4:] == firsts[x[0]] for x in one) and sorted(x[3] for x in one if x[0] == "p1") == list(range(1, 9))


def listing(folder):
    return sorted(p.name for p in folder.iterdir())


def test_atomic_sink_publishes_whole_writes(spark, tmp_path):
    out = tmp_path / "reports" / "findings"
    df = spark.range(100).select("id", F.concat(F.lit("é "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") > 5, 1.5).alias("x")).repartition(4)
    atomic.write_atomic(df, str(out))
    back = atomic.read_atomic(spark, str(out), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert listing(out.parent) == ["findings"]
    atomic.write_atomic(df.where("id < 3"), str(out))
    assert atomic.read_atomic(spark, str(out), df.schema).count() == 3 and listing(out.parent) == ["findings"]
    with pytest.raises(Exception, match="FileExistsError"):
        atomic.write_atomic(df, str(out), overwrite=False)
    assert atomic.read_atomic(spark, str(out), df.schema).count() == 3 and listing(out.parent) == ["findings"]
    atomic.write_atomic(df.where("false"), str(tmp_path / "none"))
    assert atomic.read_atomic(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    out = tmp_path / "r" / "findings"
    atomic.write_atomic(spark.range(10), str(out))
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        atomic.write_atomic(bad, str(out))
    assert listing(out.parent) == ["findings"] and atomic.read_atomic(spark, str(out), "id long").count() == 10
    with pytest.raises(Exception, match="lost"):
        atomic.write_atomic(bad, str(tmp_path / "r" / "other"))
    assert listing(out.parent) == ["findings"]
