"""Row numbers and quantiles over a range sort, against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameledger.operators import ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot key, a null key, ties, and one value far from all others."""
    rng = np.random.default_rng(0)
    n = 4000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    v = rng.integers(0, 500, n).astype(float)
    v[7] = 1e15
    return spark.createDataFrame([(None if k is None else str(k), int(i), float(x)) for i, (k, x) in enumerate(zip(key, v))], "k string, i long, v double").repartition(6)


def test_row_numbers_match(skewed):
    got = ranking.sorted_row_number(skewed, ["k"], ["v", "i"], "rn", "n").toPandas()
    want = got.sort_values(["v", "i"]).assign(k=lambda d: d.k.fillna("~")).groupby("k")
    assert (want.cumcount() + 1 == got.loc[want.cumcount().index, "rn"]).all()
    assert (want["k"].transform("size") == got.loc[want.cumcount().index, "n"]).all()
    whole = ranking.sorted_row_number(skewed, [], [F.col("v").desc(), F.col("i")], "rn").toPandas().sort_values(["v", "i"], ascending=[False, True])
    assert whole.rn.tolist() == list(range(1, 4001))
    assert ranking.sorted_row_number(skewed.limit(0), ["k"], ["v"], "rn").count() == 0


def test_an_outlier_makes_no_large_part(spark, skewed):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = ranking._placed(skewed, [], ["v", "i"]).groupBy("_part").count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 8 and parts.max() < 3 * parts.median()


def test_quantiles_match(spark, skewed):
    shares = {"lo": 0.025, "mid": 0.5, "hi": 0.975, "top": 1.0}
    got = {r.k: r for r in ranking.exact_quantiles(skewed, ["k"], "v", shares).collect()}
    data = skewed.toPandas()
    for k, v in data.groupby(data.k.fillna("~")).v:
        row = got[None if k == "~" else k]
        assert [row[n] for n in shares] == pytest.approx(np.quantile(v, list(shares.values())).tolist())
    odd = spark.createDataFrame([("x", None), ("x", float("nan")), ("x", 3.0), ("y", None)], "k string, v double")
    assert [tuple(r) for r in ranking.exact_quantiles(odd, ["k"], "v", {"m": 0.5}).collect()] == [("x", 3.0)]
    alone = ranking.exact_quantiles(skewed, [], "v", {"m": 0.25}).first()
    assert alone.m == pytest.approx(float(pd.Series(data.v).quantile(0.25)))
