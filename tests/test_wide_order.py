"""Numbers of findings beyond 64 bits."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans import gate_queries

SF = "/root/testdata/sf0.001"
SHIFT = 20_000_000


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The tables with order keys of lineitem that leave 64 bits in `ord`, alike in all else."""
    out = tmp_path_factory.mktemp("far")
    for name in os.listdir(SF):
        if name != "lineitem.parquet":
            os.symlink(f"{SF}/{name}", out / name)
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_orderkey", F.col("l_orderkey") + SHIFT).write.parquet(f"{out}/lineitem.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["attribution_touched", "ratchet_counted", "retained_context", "ratchet_valued"])
def test_order_beyond_64_bits(spark, far, name):
    near = gate_queries.QUERIES[name](spark, SF)
    wide = gate_queries.QUERIES[name](spark, far)
    assert dict(near.dtypes)["ord"] == "bigint" and dict(wide.dtypes)["ord"] == "decimal(38,0)"
    key = lambda r: (r[0], str(r))
    want = sorted(((r[0] + SHIFT * 8 * 100_000 * 20_000_000, *r[1:]) for r in near.collect()), key=key)
    got = sorted(((int(r[0]), *r[1:]) for r in wide.collect()), key=key)
    assert got == want and got[-1][0] > 1 << 63
