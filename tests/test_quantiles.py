import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textdrift.operators import counts as co
from textdrift.operators.quantiles import quantiles


def expected(rows, probabilities):
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault((g, h), []).append(v)
    return {k: (len(v), [float(x) for x in np.quantile(v, probabilities)]) for k, v in groups.items()}


@pytest.mark.parametrize("parts", [1, 13])
def test_quantiles_match_numpy(spark, parts):
    r = random.Random(1)
    rows = [("hot", "a", r.choice([0.1, 2.5, -3.0])) for _ in range(4000)]           # few values, one large group
    rows += [(f"g{r.randrange(9)}", r.choice(["a", None]), r.gauss(0, 1e6)) for _ in range(500)]
    rows += [("one", "a", 7.0), ("nulls", "a", None), (None, None, 1.0), (None, None, 2.0)]
    df = spark.createDataFrame(rows, "g string, h string, v double").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = quantiles(df, ["g", "h"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = expected(rows, (0.0, 0.25, 0.5, 0.9, 1.0))
    assert {(x.g, x.h) for x in got} == set(want) and len(got) == len(want)
    for x in got:
        n, q = want[x.g, x.h]
        assert x.n == n and x.quantiles == pytest.approx(q, rel=1e-12)


def test_empty_and_integer_values(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert quantiles(df, ["g"], "v", (0.5,)).count() == 0
    df = spark.range(10).select(F.lit("x").alias("g"), F.col("id").alias("v"))
    assert quantiles(df, ["g"], "v", (0.5,)).first().quantiles == [4.5]


def test_plan_has_no_percentile(spark):
    df = spark.createDataFrame([("d", "T0", 3), ("d", "T0", 5), (None, "T1", 4)], "dataset string, stage string, word_count long")
    out = co.word_count_distribution(df)
    assert "percentile" not in out._jdf.queryExecution().toString().lower()
    rows = {(r.dataset, r.stage): (r.q1, r.median, r.q3, r["mean"]) for r in out.collect()}
    assert rows == {("d", "T0"): (3.5, 4.0, 4.5, 4.0), (None, "T1"): (4.0, 4.0, 4.0, 4.0)}


def test_shares_need_no_window(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)], "s string")
    out = co.value_shares(df, "s")
    assert "Window" not in out._jdf.queryExecution().toString()
    assert {r.s: (r.n, r.percent) for r in out.collect()} == {"a": (3, 75.0), None: (1, 25.0)}
