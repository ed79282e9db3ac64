import numpy as np
import pytest
from pyspark.sql import functions as F

from isoreach import GridSpec, checks, read_example, sample_pmf, transform_pmf
from isoreach.operators import prep
from isoreach.operators.sampling import evolving_sizes, sample_sizes

SF = "/root/testdata/sf0.001"


def surface(spark, xs):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(xs)], "cell_id long, value double")


def test_transform_pmf(spark):
    assert [r[1] for r in transform_pmf(surface(spark, [10.0, 20.0, 30.0, 40.0])).orderBy("cell_id").collect()] == pytest.approx([0.1, 0.2, 0.3, 0.4])
    out = [r[1] for r in transform_pmf(surface(spark, [None, 10.0, 30.0])).orderBy("cell_id").collect()]
    assert out[0] is None and sum(out[1:]) == pytest.approx(1)
    assert transform_pmf(surface(spark, [1.0, 3.0]), return_total=True)[1] == 4
    assert transform_pmf(surface(spark, [1.0, 3.0]), validate=False).agg(F.sum("value")).first()[0] == 1
    for xs, msg in (([1.0, -1.0], "must be >= 0"), ([None], "only NA"), ([0.0, 0.0], "is zero")):
        with pytest.raises(ValueError, match=msg):
            transform_pmf(surface(spark, xs))


def counts(df):
    return {(r["iteration"], r["cell_id"]): r["count"] for r in df.collect()}


def test_sampling(spark):
    x = surface(spark, [float(v) for v in np.linspace(1, 10, 25)])
    a = counts(sample_pmf(spark, x, n=4000, iterations=3, seed=1))
    for t in (1, 2, 3):
        assert sum(v for (i, _), v in a.items() if i == t) == 4000
    assert a == counts(sample_pmf(spark, x.repartition(7), n=4000, iterations=3, seed=1)) != counts(sample_pmf(spark, x, n=4000, iterations=3, seed=2))
    assert np.corrcoef([a.get((1, c), 0) for c in range(1, 26)], np.linspace(1, 10, 25))[0, 1] > 0.7
    e = counts(sample_pmf(spark, x, n=300, iterations=4, evolve_prop=0.3, seed=1))
    assert sum(e.values()) == 1200
    s = [[e.get((t, c), 0) for c in range(1, 26)] for t in (1, 2)]
    assert np.corrcoef(s[0], s[1])[0, 1] > 0
    assert counts(sample_pmf(spark, x, n=0)) == {}
    assert len(counts(sample_pmf(spark, x, n=3, replace_0=False))) == 25
    with pytest.warns(UserWarning):
        assert {t for t, _ in counts(sample_pmf(spark, x, n=5, iterations=3, evolve_prop=0))} == {1}
    assert counts(sample_pmf(spark, surface(spark, [3.0]), n=7)) == {(1, 1): 7}
    for bad in ({"iterations": 0}, {"prob": 2, "size": 1}, {"evolve_prop": 2, "n": 1}, {"method": "nope", "size": 1, "prob": 0.1}, {}):
        with pytest.raises(ValueError):
            sample_pmf(spark, x, **bad)


def test_sizes():
    assert evolving_sizes([100] * 5, 0.5) == [(100, 0)] + [(50, 50)] * 4
    assert all(v <= 1000 for v in sample_sizes(5, size=1000, prob=0.05, method="binomial"))
    assert abs(sample_sizes(1, size=1000, prob=0.05)[0] - 50) < 25
    assert len(sample_sizes(3, size=10, prob=0.5, method="nbinom")) == 3
    assert sample_sizes(2, method=lambda: [1, 2]) == [1, 2]
    with pytest.raises(ValueError):
        sample_sizes(2, method=lambda: [1])


def test_grid_and_prep(spark):
    g = GridSpec(4, 4, 0, 4, 0, 4)
    x = surface(spark, [float(i) for i in range(1, 17)])
    assert {r[0]: r[1] for r in prep.block_aggregate(x, g, 2).collect()} == {1: 14, 2: 22, 3: 46, 4: 54}
    pts = spark.createDataFrame([(0.5, 3.5), (0.6, 3.4), (4.0, 0.0), (9.0, 9.0)], "x double, y double")
    assert {r[0]: r[1] for r in prep.rasterize_points(pts, g).collect()} == {1: 2, 16: 1}
    c = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 50.0, 50.0)], "cell_id long, x double, y double")
    f = spark.createDataFrame([("a", 0.0, 0.0)], "facility_id string, x double, y double")
    assert {r[0]: r[2] for r in prep.euclidean_distance(c, f, 5).collect()} == {1: 0, 2: 5}
    assert prep.mask(x, c).count() == 3 and prep.missing_in_mask(x.filter("cell_id > 1"), c).collect()[0][0] == 1


def test_checks(spark):
    with pytest.raises(ValueError, match=r"Length of a \(1\) must match length of b \(2\)"):
        checks.check_lengths_match([1], [1, 2], "a", "b")
    with pytest.raises(TypeError, match="must be one of the following classes: DataFrame"):
        checks.check_surface(1, "x")
    checks.check_range([0.5, None, float("nan")], 0, 1, "x")
    for f, args in ((checks.check_less, (1, 1, "x")), (checks.check_no_missing, ([None], "x")), (checks.check_length, ([1], 2, "x")), (checks.check_integer, (1.5, "x"))):
        with pytest.raises(ValueError):
            f(*args)


def test_source(spark):
    assert "customer" in read_example(spark, SF)
    assert read_example(spark, SF, "region").count() == 5
    with pytest.raises(ValueError, match="available"):
        read_example(spark, SF, "none")


def tasks_of(df):
    """How many tasks the rows of a result come from."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().count()


def test_pairs_are_made_on_all_cores(spark):
    """Cells of one small file, which is one task, meet facilities in many."""
    c = spark.range(2000).selectExpr("id AS cell_id", "CAST(id % 40 AS double) AS x", "CAST(id % 30 AS double) AS y").coalesce(1)
    f = spark.range(20).selectExpr("id AS facility_id", "CAST(id AS double) AS x", "CAST(id AS double) AS y")
    d = prep.euclidean_distance(c, f, 10)
    far = c.crossJoin(f.toDF("facility_id", "u", "v")).filter("(x - u) * (x - u) + (y - v) * (y - v) <= 100").count()
    assert tasks_of(d) > 4 and d.count() == far


def test_zones_are_laid_on_all_cores(spark):
    """As above, for cells and zones, whose sums for cells in one zone are not shuffled."""
    c = spark.range(2000).selectExpr("id AS cell_id").coalesce(1)
    tiles = c.selectExpr("cell_id", "cell_id % 3 AS zone")
    z = prep.rasterize_zones(tiles, spark.range(300).selectExpr("id AS location_id", "id % 3 AS zone", "CAST(id AS double) AS value"))
    assert tasks_of(z) > 4 and z.count() == 2000 * 100


def test_zones_of_cells_in_several(spark):
    """Sums over repeated tiles, repeated values, cells and layers in several zones, and missing values; whole numbers stay so."""
    tiles = [(c, z) for c, zs in {1: [0], 2: [0, 1], 3: [1, 1], 4: [0, 1, 1, 2], 5: [None], 6: [9], None: [0, 1]}.items() for z in zs]
    values = [(0, "a", 3), (0, "a", 4), (1, "a", 5), (1, "b", 7), (2, "b", None), (2, "c", None), (1, None, 2), (None, "a", 1)]
    want = {}
    for c, z in tiles:
        for y, k, v in values:
            if z is not None and z == y:
                want.setdefault((c, k), []).append(v)
    want = {k: sum(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in want.items()}
    t = spark.createDataFrame(tiles, "cell_id int, zone int")
    for kind in ("long", "double", "decimal(9,2)"):
        v = spark.createDataFrame(values, "zone int, location_id string, value int").withColumn("value", F.col("value").cast(kind))
        got = prep.rasterize_zones(t, v)
        rows = got.collect()
        assert {(r["cell_id"], r["facility_id"]): r["value"] for r in rows} == want and len(rows) == len(want)
        assert got.dtypes[2][1] == v.agg(F.sum("value")).dtypes[0][1]
