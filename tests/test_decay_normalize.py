# Input vectors of the tests below are fixed values, equal to those of the reference suite so that results compare.
import math

import pytest
from pyspark.sql import functions as F

from isoreach import calc_choice, calc_decay, calc_normalize


def distances(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id int, value double")


def run(df, **kw):
    return [r["weight"] for r in calc_decay(df, **kw).orderBy("id").collect()]


def test_closed_forms(spark):
    d = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
    df = distances(spark, d)
    assert run(df, method="gaussian", sigma=20) == pytest.approx([math.exp(-x * x / 800) for x in d])
    assert run(df, method="exponential", sigma=0.1) == pytest.approx([math.exp(-0.1 * x) for x in d])
    assert run(df, method="inverse", c=1) == pytest.approx([1 / (x + 1) for x in d])
    assert run(distances(spark, [1.0, 11.0, 21.0]), method="power", sigma=2) == pytest.approx([1, 11**-2, 21**-2])
    assert run(distances(spark, [0.0]), method="power", sigma=2) == [math.inf]


def test_binary_and_missing(spark):
    d = distances(spark, [0.0, 20.0, 40.0, 60.0, 50.0, None])
    assert run(d, method="binary", sigma=50) == [1, 1, 1, 0, 1, None]
    assert run(d, method="gaussian", sigma=50)[-1] is None
    assert run(d.limit(0), method="gaussian") == []


@pytest.mark.parametrize("kw", [{"sigma": 0}, {"sigma": -1}, {"method": "nope"}, {"sigma": "x"}])
def test_decay_errors(spark, kw):
    with pytest.raises((ValueError, TypeError)):
        calc_decay(distances(spark, [1.0]), **kw)


def test_custom_decay(spark):
    df = distances(spark, [0.0, 1.0])
    assert run(df, method=lambda d, sigma, scale: scale * F.exp(-(d * d) / (2 * sigma**2)), sigma=2, scale=2) == pytest.approx([2, 2 * math.exp(-1 / 8)])
    assert run(df, method=lambda d, k=1.0: 1 / (1 + k * d), sigma=5, other=3) == [1, 0.5]
    with pytest.raises(TypeError):
        run(df, method=lambda d, sigma: d * sigma)


def vector(spark, xs):
    return spark.createDataFrame([(1, f"f{i}", x) for i, x in enumerate(xs)], "cell_id long, facility_id string, weight double")


def norm(spark, xs, method, **kw):
    return [r["weight"] for r in calc_normalize(vector(spark, xs), method, **kw).orderBy("facility_id").collect()]


def test_normalize(spark):
    x = [0.5, 1.0, 1.5, 2.0]
    assert norm(spark, x, "standard") == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert norm(spark, x, "semi") == pytest.approx([0.1, 0.2, 0.3, 0.4])
    assert norm(spark, x, "reference") == pytest.approx([v / 2 for v in x])
    assert norm(spark, x, "reference", ref_value=4) == pytest.approx([v / 4 for v in x])
    assert sum(norm(spark, x, "standard", a0=1)) == pytest.approx(5 / 6)
    assert norm(spark, [0.0] * 4, "standard") == [None] * 4
    assert norm(spark, [0.0] * 2, "standard", a0=1) == [0, 0]
    y = norm(spark, [0.5, None, 1.5, 2.0], "standard")
    assert y[1] is None and sum(v for v in y if v is not None) == pytest.approx(1)
    assert norm(spark, [0.2, 0.3, 0.4], "semi") == [0.2, 0.3, 0.4]
    assert norm(spark, [0.2, 0.3, 0.4], "semi", a0=0.5) == pytest.approx([v / 1.4 for v in (0.2, 0.3, 0.4)])
    assert norm(spark, [0.25, 0.75], "semi") == [0.25, 0.75]
    assert norm(spark, [None, None], "standard") == [None, None]
    assert norm(spark, [5.0], "standard") == [1]
    assert norm(spark, [-1.0, -2.0], "standard") == [None, None]
    assert norm(spark, [math.nan, 2.0], "standard")[1] == 1
    assert norm(spark, x, lambda df, by: df.withColumn("weight", F.col("weight") / by), by=2) == [v / 2 for v in x]
    assert sum(r["weight"] for r in calc_normalize(vector(spark, x), keys=()).collect()) == pytest.approx(1)
    for bad in ({"method": "nope"}, {"method": "standard", "a0": -1}):
        with pytest.raises(ValueError):
            norm(spark, x, **bad)


def test_choice(spark):
    f1, f2 = [0.5, 0.3, 0.2, 0.4, 0.6, 0.8, 0.1, 0.7, 0.9], [0.2, 0.4, 0.6, 0.3, 0.1, 0.5, 0.8, 0.2, 0.4]
    w = spark.createDataFrame([(i + 1, f, v) for f, xs in (("f1", f1), ("f2", f2)) for i, v in enumerate(xs)], "cell_id long, facility_id string, weight double")
    a = spark.createDataFrame([("f1", 100.0), ("f2", 50.0)], "facility_id string, attractiveness double")
    p = {(r[0], r[1]): r[2] for r in calc_choice(w, a).select("cell_id", "facility_id", "probability").collect()}
    assert [p[i, "f1"] for i in range(1, 10)] == pytest.approx([0.8333333333, 0.6, 0.4, 0.7272727273, 0.9230769231, 0.7619047619, 0.2, 0.875, 0.8181818182])
    assert all(p[i, "f1"] + p[i, "f2"] == pytest.approx(1) for i in range(1, 10))
    out = calc_choice(w, a, a0=0.5).groupBy("cell_id").agg(F.sum("probability").alias("s")).collect()
    assert all(r["s"] < 1 for r in out)
    assert calc_choice(w.withColumn("weight", F.lit(0.0)), a).filter("probability IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        calc_choice(w, a.withColumn("attractiveness", F.lit(-1.0)))
