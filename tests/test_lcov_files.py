"""LCOV files read split by split, against the same reports as rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import lcov


def reports():
    r = random.Random(3)
    record = lambda i: f"TN:t{i}\nSF:src/{i}.ts\n" + "".join(f"DA:{n},{r.randrange(3)}\n" for n in range(1, r.randrange(2, 9))) + "# note\n\nLF:2\nLH:1\nend_of_record\n"
    large = "".join(record(i) for i in range(900))
    return {
        "large": large,
        "crlf": large[:4000].replace("\n", "\r\n"),
        "open": record(1) + "SF:src/open.ts\nDA:1,1\n",
        "open at once": "SF:src/only.ts\nDA:1,1",
        "ends": "end_of_record\nend_of_record\n" + record(5),
        "indented": "  SF:a.ts\n  DA:1,1\n  end_of_record\n SF:b.ts\n end_of_record  \n\n" + record(6) + "\n# tail\n",
        "odd tag": "SF:c.ts\nend_of_recordX\nDA:1,1\nend_of_record",
        "empty": "",
        "blank": "\n \n",
        "no file": "DA:1,1\nend_of_record\n",
    }


def shown(found):
    """Entries by record, in the order of records, without their numbers."""
    by = {}
    for r in found:
        by.setdefault((r.report.rsplit("/", 1)[-1].removesuffix(".info").replace("%20", " "), r.record), []).append((r.seq, r.tag, r.rest, r.file))
    out = {}
    for (report, _), rows in sorted(by.items()):
        out.setdefault(report, []).append([x[1:] for x in sorted(rows)])
    return out


@pytest.mark.parametrize("split", ["3k", "128m"])
def test_files_equal_rows(spark, tmp_path, split):
    for name, text in reports().items():
        (tmp_path / f"{name}.info").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = lcov.read_reports(spark, str(tmp_path))
        got = shown(found.collect())
        tasks = found.where(F.endswith("report", F.lit("large.info"))).select(F.spark_partition_id().alias("p")).distinct().count()
        problems = {(r.report.rsplit("/", 1)[-1], r.problem) for r in lcov.problems(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rows = spark.createDataFrame(list(reports().items()), "report string, text string")
    want = shown(lcov.entries(rows).collect())
    got.pop("odd tag"), want.pop("odd tag")
    assert got == want and len(got["large"]) == 900
    assert split != "3k" or tasks > 5
    # A line that only begins like an end is an unknown tag either way.
    assert ("odd%20tag.info", "unknown tag") in problems and ("open.info", "unterminated record") in problems and ("empty.info", "no records") in problems
    assert {r for r, p in problems if p == "no records"} == {"empty.info", "blank.info"}


def test_numbers_ascend_within_a_file(spark, tmp_path):
    (tmp_path / "a.info").write_text(reports()["large"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = lcov.read_reports(spark, str(tmp_path)).where("tag = 'SF'").orderBy("record").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.rest for r in rows] == [f"src/{i}.ts" for i in range(900)] and len({r.record for r in rows}) == 900
