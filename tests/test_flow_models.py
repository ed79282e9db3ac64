# Input vectors of the tests below are fixed values, equal to those of the reference suite so that results compare.
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoreach import GridSpec, compute_access, e2sfca, gather_demand, gather_weighted, spread_weighted, summarize, two_sfca
from isoreach import format_result, format_summary
from isoreach.functions.decay import calc_decay
from isoreach.operators.normalize import calc_normalize
from isoreach.plans.ifca import ifca

D1, D2 = [1, 2, 3, 2, 3, 4, 3, 4, 5], [5, 4, 3, 4, 3, 2, 3, 2, 1]


def surface(spark, xs):
    return spark.createDataFrame([(i + 1, None if v is None else float(v)) for i, v in enumerate(xs)], "cell_id long, value double")


def pairs(spark, name="value", **layers):
    return spark.createDataFrame([(i + 1, f, None if v is None else float(v)) for f, xs in layers.items() for i, v in enumerate(xs)], f"cell_id long, facility_id string, {name} double")


def case(spark):
    supply = spark.createDataFrame([("facility1", 10.0, 20.0), ("facility2", 15.0, 25.0)], "id string, doctors double, nurses double")
    return surface(spark, range(10, 100, 10)), supply, pairs(spark, facility1=D1, facility2=D2)


def col(df, name):
    return [r[name] for r in df.orderBy("cell_id").collect()]


def test_gather(spark):
    w = pairs(spark, "weight", zone_A=[0.5] * 9, zone_B=[0.5] * 9)
    assert gather_weighted(surface(spark, range(1, 10)), w, simplify=True) == {"zone_A": 22.5, "zone_B": 22.5}
    two = surface(spark, range(1, 10)).withColumn("layer", F.lit("sim1")).unionByName(surface(spark, range(2, 20, 2)).withColumn("layer", F.lit("sim2")))
    out = gather_weighted(two, w, layers=["sim1", "sim2"])
    assert out.columns == ["unit_id", "sim1_weighted_sum", "sim2_weighted_sum"] and {tuple(r)[1:] for r in out.collect()} == {(22.5, 45.0)}
    v = surface(spark, [1, 2, 3, 4, None, 6, 7, 8, 9])
    wn = pairs(spark, "weight", a=[0.5] * 8 + [None])
    assert gather_weighted(v, wn, simplify=True) == {"a": 15.5}
    assert gather_weighted(v, wn, na_rm=False, grid=GridSpec(3, 3), simplify=True) == {"a": None}
    assert gather_weighted(surface(spark, [0] * 9), w, simplify=True) == {"zone_A": 0, "zone_B": 0}
    with pytest.raises(ValueError, match="geometry"):
        gather_weighted(v, w, grid=GridSpec(3, 3), weights_grid=GridSpec(5, 5))
    with pytest.raises(Exception, match="between 0 and 1"):
        gather_demand(v, pairs(spark, "weight", a=[1.5] * 9)).collect()


def test_spread(spark):
    w = pairs(spark, "weight", u1=range(1, 10), u2=range(9, 0, -1))
    v = spark.createDataFrame([("u1", 10.0, 30.0), ("u2", 20.0, 40.0)], "facility_id string, val1 double, val2 double")
    out = spread_weighted(v, w, name_prefix="test_")
    assert col(out, "test_val1") == list(range(190, 100, -10)) and sum(col(out, "test_val2")) == 3150
    n = spark.createDataFrame([("u1", None), ("u2", 1.0)], "facility_id string, val1 double")
    total, unit = spread_weighted(n, w, full_output=True)
    assert sum(col(total, "val1")) == 45 and unit.count() == 18
    with pytest.raises(ValueError, match="not found"):
        spread_weighted(v, w, ["none"])


def test_e2sfca_goldens(spark):
    demand, supply, dist = case(spark)
    p = {"method": "gaussian", "sigma": 2}
    r = e2sfca(demand, supply, dist, p, "identity", id_col="id")
    assert col(r.accessibility, "doctors") == pytest.approx([0.0785200493, 0.0610828397, 0.0497677277, 0.0610828397, 0.0497677277, 0.0526417919, 0.0497677277, 0.0526417919, 0.0634979901])
    assert sum(d * a for d, a in zip(range(10, 100, 10), col(r.accessibility, "doctors"), strict=True)) == pytest.approx(25)
    s = e2sfca(demand, supply, dist, p, "standard", id_col="id")
    assert col(s.accessibility, "nurses") == pytest.approx([0.1118570578, 0.0860489119, 0.0680581618, 0.0860489119, 0.0680581618, 0.0694713366, 0.0680581618, 0.0694713366, 0.0823548774])
    assert col(e2sfca(demand, supply, dist, p, "semi", id_col="id").accessibility, "doctors") == pytest.approx(col(r.accessibility, "doctors"))
    wide = {"method": "gaussian", "sigma": 6}
    assert col(e2sfca(demand, supply, dist, wide, "semi", id_col="id").accessibility, "doctors") != pytest.approx(col(e2sfca(demand, supply, dist, wide, "identity", id_col="id").accessibility, "doctors"))
    u = gather_demand(demand, calc_normalize(calc_decay(dist, **p))).collect()
    assert sum(x[1] for x in u) == pytest.approx(450)
    steps = compute_access(demand, supply, calc_normalize(calc_decay(dist, **p)), calc_decay(dist, **p), "id", validate=False)
    assert col(steps, "doctors") == pytest.approx(col(s.accessibility, "doctors"))


def test_two_sfca(spark):
    demand, supply, dist = case(spark)
    r = two_sfca(demand, supply, dist, 3, id_col="id")
    assert r.type == "2SFCA" and r.parameters["decay_params"]["method"] == "binary"
    a, b = 10 / 220, 15 / 380
    assert col(r.accessibility, "doctors") == pytest.approx([a, a, a + b, a, a + b, b, a + b, b, b])
    far = two_sfca(demand, supply, pairs(spark, facility1=[9] * 8 + [None], facility2=[9] * 8 + [1]), 3, id_col="id").accessibility
    assert col(far, "doctors")[0] == 0.0  # facility1 gathers nothing: infinite ratio, ignored where its weight is 0


def test_model_errors(spark):
    demand, supply, dist = case(spark)
    for kw in ({"demand_normalize": "reference"}, {"decay_params": {}}, {"supply_cols": ["x"]}, {"indicator_names": ["one"]}):
        with pytest.raises(ValueError):
            e2sfca(demand, supply, dist, id_col="id", **kw)
    with pytest.raises(ValueError, match="unique"):
        e2sfca(demand, supply.unionByName(supply), dist, id_col="id")
    with pytest.raises(ValueError, match="not found in supply"):
        e2sfca(demand, supply.filter("id = 'facility1'"), dist, id_col="id")


def equilibrium(p, s, w, lam=0.5, steps=200):
    a = s.copy()
    for _ in range(steps):
        h = w * a / (w * a).sum(1, keepdims=True)
        u = (p[:, None] * h * w).sum(0)
        a = (1 - lam) * a + lam * np.where(u > 0, s / u, 0)
    return u


def test_ifca(spark):
    demand, supply, dist = case(spark)
    sup = supply.select(F.col("id").alias("facility_id"), F.col("doctors").alias("supply")).unionByName(spark.createDataFrame([("zero", 0.0)], "facility_id string, supply double"))
    p = {"method": "gaussian", "sigma": 2}
    full = ifca(spark, dist, demand, sup, p, max_iter=4)
    h = {(r[0], r[1]): r for r in full.iterations["history"].collect()}
    assert h[2, "facility1"][2:] == pytest.approx((57.5373853745, 10 / 57.5373853745, 5.0869000210))
    assert h[4, "facility2"]["utilization"] == pytest.approx(181.2031021191)
    done = ifca(spark, dist, demand, sup, p, max_iter=40, fast=True)
    u = {r["facility_id"]: r["utilization"] for r in done.facilities.collect()}
    assert done.iterations["converged"] and done.iterations["iterations"] == 25 and u["zero"] == 0
    assert [u["facility1"], u["facility2"]] == pytest.approx([73.6810528430, 159.3891943834])
    w = np.exp(-(np.array([D1, D2]).T ** 2) / 8)
    assert equilibrium(np.arange(10.0, 100, 10), np.array([10.0, 15.0]), w) == pytest.approx([73.6810528430, 159.3891943834], rel=1e-5)
    assert full.extra["util_probs"].count() == 18
    for bad in ({"lam": 2}, {"max_iter": 0}, {"tolerance": 0}, {"convergence_type": "x"}, {"layers": [1], "max_iter": 3}):
        with pytest.raises(ValueError):
            ifca(spark, dist, demand, sup, p, **bad)


def test_summary(spark):
    demand, supply, dist = case(spark)
    r = e2sfca(demand, supply, dist, {"method": "gaussian", "sigma": 2}, id_col="id")
    s = summarize(r, GridSpec(3, 4))
    row = s["accessibility"].filter("measure = 'doctors'").first()
    xs = np.array(col(r.accessibility, "doctors"))
    assert [row["q25"], row["sd"], row["coverage"]] == pytest.approx([np.quantile(xs, 0.25), xs.std(ddof=1), 0.75])
    assert s["facilities"].filter("measure = 'doctors'").first()["total"] == 25
    assert "E2SFCA" in format_summary(s) and "gaussian" in format_result(r) and "doctors" in str(r)


def test_ifca_steps_leave_pairs_where_they_are(spark, monkeypatch):
    """A step shuffles sums of facilities only: neither the pairs nor the demand of cells move, and the pairs aren't sorted again."""
    module, seen = sys.modules["isoreach.plans.ifca"], []
    keep = module.utilization
    monkeypatch.setattr(module, "utilization", lambda *a: (seen.append(keep(*a)), seen[-1])[1])
    dist = spark.range(4000).selectExpr("id % 400 AS cell_id", "id % 7 AS facility_id", "CAST(id % 50 AS double) AS value").dropDuplicates(["cell_id", "facility_id"])
    demand = spark.range(400).selectExpr("id AS cell_id", "CAST(id AS double) AS value")
    sup = spark.range(7).selectExpr("id AS facility_id", "CAST(id AS double) AS supply")
    r = ifca(spark, dist, demand, sup, max_iter=4)
    assert len(seen) == 3 and r.facilities.count() == 7
    for df in seen:
        step = df._jdf.queryExecution().executedPlan().toString().partition("InMemoryRelation")[0]
        assert step.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(facility_id" in step and "SortMergeJoin" not in step
    access = r.accessibility._jdf.queryExecution().executedPlan().toString()
    assert access.count("Exchange hashpartitioning(facility_id") <= 2  # facilities meet their state; no pairs


def test_ifca_of_demand_in_several_rows_and_no_supply(spark):
    """Rows of one cell add up; without any supply all is zero."""
    dist = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0), (2, "a", 5.0), (2, "b", 40.0)], "cell_id int, facility_id string, value double")
    sup = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("z", 0.0)], "facility_id string, supply double")
    once, twice = (spark.createDataFrame(x, "cell_id int, value double") for x in ([(1, 9.0), (2, 4.0)], [(1, 5.0), (2, 4.0), (1, 4.0), (3, 1.0), (1, None)]))
    a, b = ({x["facility_id"]: tuple(x)[1:] for x in ifca(spark, dist, d, sup, max_iter=4).facilities.collect()} for d in (once, twice))
    assert set(a) == {"a", "b", "z"} and all(b[k] == pytest.approx(a[k]) for k in a) and a["z"] == (0.0, 0.0, 0.0, 0.0)
    none = ifca(spark, dist, once, sup.withColumn("supply", sup.supply * 0), max_iter=3)
    assert [tuple(x)[1:] for x in none.facilities.collect()] == [(0.0, 0.0, 0.0, 0.0)] * 3
