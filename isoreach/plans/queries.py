"""The registered queries of the accessibility operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoreach.functions.decay import calc_decay
from isoreach.grid import GridSpec
from isoreach.operators import prep
from isoreach.operators.choice import calc_choice
from isoreach.operators.flow import gather_demand, gather_weighted, spread_weighted
from isoreach.operators.normalize import calc_normalize
from isoreach.operators.sampling import sample_pmf, transform_pmf
from isoreach.operators.summary import facility_stats, measure_stats
from isoreach.plans.ifca import ifca
from isoreach.plans.models import compute_access, e2sfca, two_sfca
from isoreach.sources import tables as T
from isoreach.streaming.demand import windowed_demand

QUERIES: dict = {}
SQL: dict[str, str] = {}

BASE = """WITH demand AS (SELECT c_custkey AS cell_id, greatest(c_acctbal, 0.0::DOUBLE) AS value FROM customer),
supply AS (SELECT s_suppkey AS facility_id, greatest(s_acctbal, 0.0::DOUBLE) AS s_cap, 1.0::DOUBLE AS s_unit FROM supplier),
distance AS (SELECT o_custkey AS cell_id, l_suppkey AS facility_id, min(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
zones AS (SELECT c_custkey AS cell_id, c_nationkey AS zone FROM customer),
layers AS (SELECT o_custkey AS cell_id, o_orderpriority AS layer, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
pmfw AS (SELECT cell_id, CAST(trunc(value * 100) AS BIGINT) AS value FROM demand),
w AS (SELECT cell_id, facility_id, exp(-(value * value) / 450.0::DOUBLE) AS weight FROM distance)
"""
#: Gaussian, sigma 15: well conditioned on the star schema.
G15 = {"method": "gaussian", "sigma": 15.0}
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = BASE + sql
        return f

    return put


def _w(s: SparkSession, d: str) -> DataFrame:
    return calc_decay(T.distance(s, d), **G15, validate=False)


def _r(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Rounded, with -0.0 as 0.0."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


def _decay(name: str, sql: str, **params) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return _r(calc_decay(T.distance(s, d), **params), 8)

    add(name, f"SELECT cell_id, facility_id, round({sql}, 8) + 0.0::DOUBLE AS weight FROM distance")(f)


def _near(d, limit=20.0, scale=2.0):
    return F.when(d <= limit, F.lit(scale) / (d + 1.0)).otherwise(F.lit(0.0))


_decay("decay_gaussian", "exp(-(value*value)/1800.0::DOUBLE)", method="gaussian", sigma=30)
_decay("decay_exponential", "exp(value * -0.05::DOUBLE)", method="exponential", sigma=0.05)
_decay("decay_power", "pow(value, -1.5::DOUBLE)", method="power", sigma=1.5)
_decay("decay_inverse", "1.0::DOUBLE/(value + 2.0::DOUBLE)", method="inverse", c=2.0)
_decay("decay_binary", "CASE WHEN value <= 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", method="binary", sigma=25)
_decay("decay_default_sigma", "exp(-(value*value)/(2.0::DOUBLE * 11.64884::DOUBLE * 11.64884::DOUBLE))", method="gaussian")
_decay("decay_custom_threshold", "CASE WHEN value <= 15 THEN 2.0::DOUBLE/(value + 1.0::DOUBLE) ELSE 0.0::DOUBLE END", method=_near, limit=15.0, unknown=1)


def _norm(name: str, sql: str, **params) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        return _r(calc_normalize(_w(s, d), **params), 8)

    add(name, f", n AS (SELECT *, sum(weight) OVER (PARTITION BY cell_id) AS s, max(weight) OVER (PARTITION BY cell_id) AS m FROM w) SELECT cell_id, facility_id, round({sql}, 8) AS weight FROM n")(f)


def _half(df: DataFrame, by: float = 2.0) -> DataFrame:
    return df.withColumn("weight", F.col("weight") / by)


_norm("normalize_identity", "weight", method="identity")
_norm("normalize_standard", "CASE WHEN s > 0 THEN weight/s END", method="standard")
_norm("normalize_standard_a0", "weight/(s+0.5::DOUBLE)", method="standard", a0=0.5)
_norm("normalize_semi", "CASE WHEN s > 1 THEN weight/s ELSE weight END", method="semi")
_norm("normalize_semi_a0", "CASE WHEN s+0.5::DOUBLE > 1 THEN weight/(s+0.5::DOUBLE) ELSE weight END", method="semi", a0=0.5)
_norm("normalize_reference_max", "CASE WHEN m > 0 THEN weight/m END", method="reference")
_norm("normalize_reference_value", "weight/2.0::DOUBLE", method="reference", ref_value=2.0)
_norm("normalize_custom", "weight/4.0::DOUBLE", method=_half, by=4.0)
_norm("choice_weights_only", "CASE WHEN s > 0 THEN weight/s END", method=lambda df: calc_choice(df).withColumnRenamed("probability", "weight"))


def _choice(name: str, power: str, outside: str, **params) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        a = T.supply(s, d).select("facility_id", F.col("s_cap").alias("attractiveness"))
        return _r(calc_choice(_w(s, d), a, **params), 8)

    add(name, f", n AS (SELECT cell_id, facility_id, weight * pow(s_cap, {power}::DOUBLE) AS x FROM w JOIN supply USING (facility_id)), t AS (SELECT *, sum(x) OVER (PARTITION BY cell_id) + {outside}::DOUBLE AS s FROM n) SELECT cell_id, facility_id, round(CASE WHEN s > 0 THEN x/s END, 8) AS probability FROM t")(f)


_choice("choice_basic", "1.0", "0.0")
_choice("choice_alpha", "1.7", "0.0", alpha=1.7)
_choice("choice_outside_option", "1.0", "1000.0", a0=1000.0)


@add("gather_weighted", "SELECT facility_id AS unit_id, round(coalesce(sum(value*weight), 0), 2) AS weighted_sum FROM w LEFT JOIN demand USING (cell_id) GROUP BY 1")
def q(s, d):
    return _r(gather_weighted(T.demand(s, d), _w(s, d)), 2)


@add("gather_na_strict", ", c AS (SELECT count(*) AS n FROM customer) SELECT facility_id AS unit_id, CASE WHEN count(value*weight) = (SELECT n FROM c) THEN round(sum(value*weight), 2) END AS weighted_sum FROM w LEFT JOIN demand USING (cell_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    n = T.table(s, d, "customer").count()
    return _r(gather_weighted(T.demand(s, d), _w(s, d), na_rm=False, grid=GridSpec(1, n)), 2)


_cols = ", ".join(f"""round(coalesce(sum(CASE WHEN layer = '{p}' THEN value*weight END), 0), 1) AS "{p}_weighted_sum" """ for p in PRIORITIES)


@add("gather_multilayer", f"SELECT facility_id AS unit_id, {_cols} FROM w LEFT JOIN layers USING (cell_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(gather_weighted(T.demand_layers(s, d), _w(s, d), layers=PRIORITIES), 1)


@add("gather_demand", "SELECT facility_id AS location_id, round(coalesce(sum(value*weight), 0), 2) AS potential_demand FROM w LEFT JOIN demand USING (cell_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(gather_demand(T.demand(s, d), _w(s, d)), 2)


@add("spread_single", "SELECT cell_id, round(sum(s_cap*weight), 4) AS s_cap FROM w JOIN supply USING (facility_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(spread_weighted(T.supply(s, d), _w(s, d), ["s_cap"]), 4)


@add("spread_multi", "SELECT cell_id, round(sum(s_cap*weight), 4) AS s_cap, round(sum(s_unit*weight), 6) AS s_unit FROM w JOIN supply USING (facility_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(_r(spread_weighted(T.supply(s, d), _w(s, d)), 4, "s_cap"), 6, "s_unit")


@add("spread_prefix", "SELECT cell_id, round(sum(s_unit*weight), 6) AS acc_s_unit FROM w JOIN supply USING (facility_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(spread_weighted(T.supply(s, d), _w(s, d), ["s_unit"], name_prefix="acc_"))


@add("spread_full_output", "SELECT cell_id, facility_id, round(s_cap*weight, 4) AS s_cap FROM w JOIN supply USING (facility_id)")
def q(s, d):  # noqa: F811
    return _r(spread_weighted(T.supply(s, d), _w(s, d), ["s_cap"], full_output=True)[1], 4)


RATIO = "CASE WHEN u <> 0 THEN {0}/(CASE WHEN u <> 0 THEN u ELSE 1 END) WHEN {0} > 0 THEN 'inf'::DOUBLE END"


def _access_sql(weights: str, norm: str, cols: dict[str, str], access: str | None = None) -> str:
    """weights, norm: SQL of the decay and of the normalised weight, with s the sum over the cell."""
    ratios = ", ".join(f"{RATIO.format(c)} AS r_{c}" for c in cols)
    sums = ", ".join(f"round(sum(CASE WHEN NOT isnan(r_{c}*weight) THEN r_{c}*weight END), 6) AS {a}" for c, a in cols.items())
    return f""", dw AS (SELECT cell_id, facility_id, {weights} AS weight FROM distance), aw AS (SELECT cell_id, facility_id, {access or weights} AS weight FROM distance),
n AS (SELECT cell_id, facility_id, {norm} AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY cell_id) AS s FROM dw)),
g AS (SELECT facility_id, coalesce(sum(value*weight), 0) AS u FROM n LEFT JOIN demand USING (cell_id) GROUP BY 1),
r AS (SELECT facility_id, {ratios} FROM g JOIN supply USING (facility_id))
SELECT cell_id, {sums} FROM aw JOIN r USING (facility_id) GROUP BY 1"""


W15, WE, WB = "exp(-(value*value)/450.0::DOUBLE)", "exp(value * -0.1::DOUBLE)", "CASE WHEN value <= 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
STD, SEMI = "CASE WHEN s > 0 THEN weight/s END", "CASE WHEN s > 1 THEN weight/s ELSE weight END"


def _model(name: str, sql: str, run) -> None:
    add(name, sql)(lambda s, d: _r(run(T.demand(s, d), T.supply(s, d), T.distance(s, d)).accessibility))


_model("e2sfca_identity", _access_sql(W15, "weight", {"s_cap": "s_cap"}), lambda p, s, x: e2sfca(p, s, x, G15, "identity", supply_cols=["s_cap"], validate=False))
_model("e2sfca_standard", _access_sql(W15, STD, {"s_cap": "s_cap"}), lambda p, s, x: e2sfca(p, s, x, G15, "standard", supply_cols=["s_cap"], validate=False))
_model("e2sfca_semi", _access_sql(W15, SEMI, {"s_cap": "s_cap"}), lambda p, s, x: e2sfca(p, s, x, G15, "semi", supply_cols=["s_cap"], validate=False))
_model("e2sfca_exponential", _access_sql(WE, STD, {"s_cap": "s_cap"}), lambda p, s, x: e2sfca(p, s, x, {"method": "exponential", "sigma": 0.1}, "standard", supply_cols=["s_cap"], validate=False))
_model("e2sfca_multi_measure", _access_sql(W15, STD, {"s_cap": "cap", "s_unit": "unit"}), lambda p, s, x: e2sfca(p, s, x, G15, "standard", indicator_names=["cap", "unit"], validate=False))
_model("two_sfca", _access_sql(WB, "weight", {"s_cap": "s_cap", "s_unit": "s_unit"}), lambda p, s, x: two_sfca(p, s, x, 12, validate=False))


@add("compute_access_mixed_weights", _access_sql(W15, STD, {"s_cap": "s_cap"}, WE))
def q(s, d):  # noqa: F811
    x = T.distance(s, d)
    other = calc_decay(x, "exponential", 0.1, validate=False)
    return _r(compute_access(T.demand(s, d), T.supply(s, d), calc_normalize(_w(s, d)), other, supply_cols=["s_cap"], validate=False))


_two = _access_sql("CASE WHEN value <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "weight", {"s_unit": "s_unit"})


@add("two_sfca_zero_vs_null", _two.replace("SELECT cell_id, round(sum(", ", a AS (SELECT cell_id, round(sum(") + ") SELECT c_custkey AS cell_id, CASE WHEN a.cell_id IS NULL THEN 'missing' WHEN s_unit IS NULL THEN 'null' WHEN s_unit = 0 THEN 'zero' ELSE 'served' END AS state FROM customer LEFT JOIN a ON a.cell_id = c_custkey")
def q(s, d):  # noqa: F811
    a = _r(two_sfca(T.demand(s, d), T.supply(s, d), T.distance(s, d), 3, supply_cols=["s_unit"], validate=False).accessibility).withColumn("here", F.lit(True))
    state = F.when(F.col("here").isNull(), "missing").when(F.col("s_unit").isNull(), "null").when(F.col("s_unit") == 0, "zero").otherwise("served")
    return T.demand(s, d).join(a, "cell_id", "left").select("cell_id", state.alias("state"))


@add("transform_pmf", "SELECT cell_id, round(value / (SELECT sum(value) FROM demand), 10) AS value FROM demand")
def q(s, d):  # noqa: F811
    return _r(transform_pmf(T.demand(s, d)), 10)


@add("pmf_total", "SELECT CAST(sum(value) AS BIGINT) AS total, count(value) AS cells, min(value) AS low FROM pmfw")
def q(s, d):  # noqa: F811
    return T.pmf_weights(s, d).agg(F.sum("value").alias("total"), F.count("value").alias("cells"), F.min("value").alias("low"))


_SAMPLE = """, cum AS (SELECT cell_id, CAST(sum(value) OVER (ORDER BY cell_id) - value AS DOUBLE) AS lo, CAST(sum(value) OVER (ORDER BY cell_id) AS DOUBLE) AS hi FROM pmfw WHERE value > 0),
tot AS (SELECT CAST(sum(value) AS DOUBLE) AS total FROM pmfw),
it AS (SELECT unnest(range(1, {T} + 1)) AS iteration), ks AS (SELECT unnest(range(0, {N})) AS k),
fresh AS (SELECT iteration, k, CAST(('0x' || substr(md5('42-' || iteration || '-' || k), 1, 13)) AS UBIGINT)::DOUBLE / 4503599627370496.0::DOUBLE * total AS x FROM it, ks, tot),
pts AS (SELECT CAST(iteration AS INTEGER) AS iteration, k, cell_id FROM fresh ASOF JOIN cum ON fresh.x >= cum.lo)
"""


@add("sample_fixed_n", _SAMPLE.format(T=3, N=2000) + "SELECT iteration, cell_id, count(*) AS count FROM pts GROUP BY 1, 2")
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), n=2000, iterations=3, seed=42)


def _evolve_sql() -> str:
    out = _SAMPLE.format(T=3, N=1000) + ", p1 AS (SELECT cell_id, '1:' || k AS point FROM pts WHERE iteration = 1)"
    for t in (2, 3):
        out += f", p{t} AS (SELECT cell_id, '{t}:' || k AS point FROM pts WHERE iteration = {t} AND k < 600 UNION ALL (SELECT cell_id, point FROM p{t - 1} ORDER BY md5('42-{t}-' || point), point LIMIT 400))"
    return out + " SELECT CAST(t AS INTEGER) AS iteration, cell_id, count(*) AS count FROM (SELECT 1 AS t, cell_id FROM p1 UNION ALL SELECT 2, cell_id FROM p2 UNION ALL SELECT 3, cell_id FROM p3) GROUP BY 1, 2"


@add("sample_evolving", _evolve_sql())
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), n=1000, iterations=3, evolve_prop=0.6, seed=42)


def _sizes_sql(first: str, ratio: str, most: int, seed: int = 7, steps: int = 3) -> str:
    """Sizes by inversion: running sums of probabilities, each from the one before; then the points of each iteration."""
    return _SAMPLE.format(T=steps, N=most).replace("'42-'", f"'{seed}-'").replace("fresh AS (SELECT", f"""logs AS (SELECT k, sum(CASE WHEN k = 0 THEN {first} ELSE ln({ratio}) END) OVER (ORDER BY k) AS log_p FROM ks), cdf AS (SELECT k, sum(exp(log_p)) OVER (ORDER BY k) AS total FROM logs),
sized AS (SELECT iteration, CAST(('0x' || substr(md5('{seed}-size-' || iteration), 1, 13)) AS UBIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM it), n AS (SELECT iteration, (SELECT count(*) FROM cdf WHERE total <= u) AS n FROM sized),
fresh AS (SELECT""").replace("FROM it, ks, tot", "FROM it JOIN n USING (iteration), ks, tot WHERE k < n") + "SELECT iteration, cell_id, count(*) AS count FROM pts GROUP BY 1, 2"


@add("sample_poisson", _sizes_sql("-1000.0::DOUBLE", "1000.0::DOUBLE / k", 2000))
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), size=5000, prob=0.2, iterations=3, seed=7)


@add("sample_binomial", _sizes_sql("3000 * ln(0.6::DOUBLE)", "0.4::DOUBLE / 0.6::DOUBLE * (3000 - k + 1) / k", 2500))
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), size=3000, prob=0.4, method="binomial", iterations=3, seed=7)


@add("sample_nbinom", _sizes_sql("40 * ln(0.05::DOUBLE)", "0.95::DOUBLE * (40 + k - 1) / k", 4000))
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), size=40, prob=0.05, method="nbinom", iterations=3, seed=7)


@add("sample_custom_size", _SAMPLE.format(T=3, N=900).replace("'42-'", "'7-'").replace("FROM it, ks, tot", "FROM it, ks, tot WHERE k < 300 * iteration") + "SELECT iteration, cell_id, count(*) AS count FROM pts GROUP BY 1, 2")
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), method=lambda step: [step, 2 * step, 3 * step], iterations=3, seed=7, step=300)


@add("sample_keep_zeros", _SAMPLE.format(T=2, N=500) + ", c AS (SELECT iteration, cell_id, count(*) AS count FROM pts GROUP BY 1, 2), a AS (SELECT CAST(iteration AS INTEGER) AS iteration, cell_id FROM it, pmfw) SELECT iteration, cell_id, coalesce(count, 0) AS count FROM a LEFT JOIN c USING (iteration, cell_id)")
def q(s, d):  # noqa: F811
    return sample_pmf(s, T.pmf_weights(s, d), n=500, iterations=2, seed=42, replace_0=False)


def _ifca_sql(steps: int, demand: list[str] | None = None) -> str:
    out = ", ws AS (SELECT cell_id, facility_id, weight, s_cap FROM w JOIN supply USING (facility_id) WHERE s_cap <> 0), a0 AS (SELECT facility_id, s_cap, s_cap AS a FROM supply WHERE s_cap <> 0)"
    for t in range(1, steps + 1):
        p = "demand" if demand is None else f"(SELECT cell_id, value FROM layers WHERE layer = '{demand[t - 1]}')"
        out += f", d{t} AS (SELECT cell_id, sum(a*weight) AS den FROM ws JOIN a{t - 1} USING (facility_id) GROUP BY 1), u{t} AS (SELECT facility_id, sum(p.value/den * weight*weight*a) AS u FROM ws JOIN a{t - 1} USING (facility_id) JOIN d{t} USING (cell_id) JOIN {p} p USING (cell_id) WHERE den > 0 GROUP BY 1), a{t} AS (SELECT facility_id, s_cap, coalesce(u, 0) AS u, CASE WHEN u > 0 THEN s_cap/u ELSE 0 END AS r, 0.5::DOUBLE*a + 0.5::DOUBLE*(CASE WHEN u > 0 THEN s_cap/u ELSE 0 END) AS a FROM (SELECT x.facility_id, x.s_cap, x.a, y.u FROM a{t - 1} x LEFT JOIN u{t} y USING (facility_id)))"
    return out


def _ifca(s, d, **kw):
    sup = T.supply(s, d).select("facility_id", F.col("s_cap").alias("supply"))
    return ifca(s, T.distance(s, d), kw.pop("demand", None) if "demand" in kw else T.demand(s, d), sup, G15, **kw)


_FAC = " SELECT s.facility_id, round(coalesce(u, 0), 3) AS utilization, round(coalesce(r, 0), 6) AS ratio, round(coalesce(a, 0), 4) AS attractiveness FROM supply s LEFT JOIN a3 USING (facility_id)"


def _facilities(df: DataFrame) -> DataFrame:
    return _r(_r(_r(df.select("facility_id", "utilization", "ratio", "attractiveness"), 3, "utilization"), 6, "ratio"), 4, "attractiveness")


@add("ifca_3_iterations", _ifca_sql(3) + _FAC)
def q(s, d):  # noqa: F811
    return _facilities(_ifca(s, d, max_iter=4).facilities)


@add("ifca_fast", _ifca_sql(3) + _FAC)
def q(s, d):  # noqa: F811
    return _facilities(_ifca(s, d, max_iter=3, fast=True).facilities)


@add("ifca_history", _ifca_sql(2) + " SELECT 1 AS iteration, facility_id, 0.0::DOUBLE AS utilization FROM a0 UNION ALL SELECT 2, facility_id, round(u, 3) FROM a1 UNION ALL SELECT 3, facility_id, round(u, 3) FROM a2")
def q(s, d):  # noqa: F811
    return _r(_ifca(s, d, max_iter=3).iterations["history"].select("iteration", "facility_id", "utilization"), 3)


@add("ifca_access", _ifca_sql(3) + " SELECT cell_id, round(sum(coalesce(r, 0)*weight), 6) AS accessibility FROM w LEFT JOIN a3 USING (facility_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(_ifca(s, d, max_iter=4).accessibility)


@add("ifca_zero_supply_refill", "SELECT count(*) AS facilities, count(*) FILTER (WHERE s_cap = 0) AS zeros FROM supply")
def q(s, d):  # noqa: F811
    f = _ifca(s, d, max_iter=2).facilities
    return f.agg(F.count("*").alias("facilities"), F.count_if((F.col("supply") == 0) & (F.col("attractiveness") == 0)).alias("zeros"))


@add("ifca_dynamic_demand", _ifca_sql(3, PRIORITIES[:3]) + _FAC.replace("round(coalesce(u, 0), 3)", "round(coalesce(u, 0), 1)"))
def q(s, d):  # noqa: F811
    r = _ifca(s, d, max_iter=4, demand=T.demand_layers(s, d), layers=PRIORITIES[:4])
    return _r(_r(_r(r.facilities.select("facility_id", "utilization", "ratio", "attractiveness"), 1, "utilization"), 6, "ratio"), 4, "attractiveness")


@add("ifca_converged")
def q(s, d):  # noqa: F811
    return _ifca(s, d, max_iter=30, fast=True, tolerance=1.0).facilities


_STATS = "round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd"


@add("summary_accessibility", _access_sql(W15, STD, {"s_cap": "s_cap"}).replace("SELECT cell_id, round(sum(", ", a AS (SELECT cell_id, (sum(").replace("END), 6)", "END))") + f") SELECT 's_cap' AS measure, {_STATS.replace('x', 's_cap').replace('mas_cap', 'max')}, round(quantile_cont(s_cap, 0.0), 6) AS q00, round(quantile_cont(s_cap, 0.25), 6) AS q25, round(quantile_cont(s_cap, 0.5), 6) AS q50, round(quantile_cont(s_cap, 0.75), 6) AS q75, round(quantile_cont(s_cap, 1.0), 6) AS q100, count(s_cap) AS covered, (SELECT count(*) FROM customer) AS cells, round(count(s_cap)::DOUBLE / (SELECT count(*) FROM customer), 6) AS coverage FROM a")
def q(s, d):  # noqa: F811
    a = e2sfca(T.demand(s, d), T.supply(s, d), T.distance(s, d), G15, "standard", supply_cols=["s_cap"], validate=False).accessibility
    return _r(measure_stats(a, ["s_cap"], T.table(s, d, "customer").count()))


@add("summary_facilities", "SELECT 's_cap' AS measure, round(min(s_cap), 2) AS min, round(max(s_cap), 2) AS max, round(avg(s_cap), 2) AS mean, round(stddev_samp(s_cap), 2) AS sd, round(sum(s_cap), 2) AS total FROM supply UNION ALL SELECT 's_unit', min(s_unit), max(s_unit), avg(s_unit), round(stddev_samp(s_unit), 2), sum(s_unit) FROM supply")
def q(s, d):  # noqa: F811
    return _r(facility_stats(T.supply(s, d)), 2)


@add("summary_coverage", "SELECT count(DISTINCT cell_id) AS covered, (SELECT count(*) FROM customer) AS cells FROM w")
def q(s, d):  # noqa: F811
    a = spread_weighted(T.supply(s, d), _w(s, d), ["s_unit"])
    return measure_stats(a, ["s_unit"], T.table(s, d, "customer").count()).select("covered", "cells")


@add("zonal_mean", "SELECT zone, round(avg(value), 6) AS mean FROM demand JOIN zones USING (cell_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    return _r(prep.zonal(T.demand(s, d), T.zones(s, d)))


@add("zonal_sum", "SELECT zone, round(sum(value), 2) AS sum, count(value) AS count FROM demand JOIN zones USING (cell_id) GROUP BY 1")
def q(s, d):  # noqa: F811
    z = prep.zonal(T.demand(s, d), T.zones(s, d), "sum").join(prep.zonal(T.demand(s, d), T.zones(s, d), "count"), "zone")
    return _r(z, 2, "sum")


@add("block_aggregate", "SELECT (cell_id//50//4)*13 + (cell_id%50)//4 + 1 AS cell_id, round(sum(value), 2) AS value FROM demand GROUP BY 1")
def q(s, d):  # noqa: F811
    grid = GridSpec(300, 50)
    return _r(prep.block_aggregate(T.demand(s, d).withColumn("cell_id", F.col("cell_id") + 1), grid, 4), 2)


@add("rasterize_points", "SELECT CAST(least(floor((50 - (p_size)) / 5), 9) * 10 + least(floor((p_retailprice - 0) / 300), 9) + 1 AS BIGINT) AS cell_id, round(CAST(count(*) AS DOUBLE), 2) AS value FROM part WHERE p_retailprice BETWEEN 0 AND 3000 AND p_size BETWEEN 0 AND 50 GROUP BY 1")
def q(s, d):  # noqa: F811
    pts = T.table(s, d, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    return _r(prep.rasterize_points(pts, GridSpec(10, 10, 0, 3000, 0, 50)), 2)


@add("mask_semi", "SELECT cell_id, value FROM demand WHERE cell_id IN (SELECT cell_id FROM zones WHERE zone < 10)")
def q(s, d):  # noqa: F811
    return prep.mask(T.demand(s, d), T.zones(s, d).filter("zone < 10"))


@add("na_report_anti", "SELECT c_custkey AS cell_id FROM customer WHERE c_custkey NOT IN (SELECT cell_id FROM distance WHERE value <= 5)")
def q(s, d):  # noqa: F811
    return prep.missing_in_mask(T.distance(s, d).filter("value <= 5").select("cell_id", "value"), T.demand(s, d))


@add("euclidean_distance", "SELECT c.cell_id, f.facility_id, round(sqrt(pow(c.x-f.x, 2) + pow(c.y-f.y, 2)), 6) AS value FROM (SELECT c_custkey AS cell_id, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS y FROM customer) c JOIN (SELECT s_suppkey AS facility_id, CAST((s_suppkey*7) % 97 AS DOUBLE) AS x, CAST((s_suppkey*11) % 89 AS DOUBLE) AS y FROM supplier) f ON sqrt(pow(c.x-f.x, 2) + pow(c.y-f.y, 2)) <= 10")
def q(s, d):  # noqa: F811
    c = T.demand(s, d).select("cell_id", (F.col("cell_id") % 97).cast("double").alias("x"), (F.col("cell_id") % 89).cast("double").alias("y"))
    f = T.supply(s, d).select("facility_id", (F.col("facility_id") * 7 % 97).cast("double").alias("x"), (F.col("facility_id") * 11 % 89).cast("double").alias("y"))
    return _r(prep.euclidean_distance(c, f, 10))


@add("rasterize_zones", "SELECT cell_id, facility_id, sum(isomean) AS value FROM zones JOIN (SELECT s_nationkey AS zone, s_suppkey AS facility_id, (s_suppkey % 10 + s_suppkey % 10 + 5) / 2.0::DOUBLE AS isomean FROM supplier) USING (zone) GROUP BY 1, 2")
def q(s, d):  # noqa: F811
    iso = T.table(s, d, "supplier").select(F.col("s_nationkey").alias("zone"), F.col("s_suppkey").alias("location_id"), (F.col("s_suppkey") % 10).alias("isomin"), (F.col("s_suppkey") % 10 + 5).alias("isomax"))
    return prep.rasterize_zones(T.zones(s, d), prep.midpoint(iso, out="value"))


@add("density_to_count", "SELECT cell_id, round(value * 2.5::DOUBLE, 4) AS value FROM demand")
def q(s, d):  # noqa: F811
    return _r(prep.density_to_count(T.demand(s, d), 2.5), 4)


@add("attribute_join", "SELECT cell_id, zone, n_name FROM zones LEFT JOIN nation ON n_nationkey = zone")
def q(s, d):  # noqa: F811
    return prep.attach(T.zones(s, d), T.table(s, d, "nation").select(F.col("n_nationkey").alias("zone"), "n_name"), "zone").select("cell_id", "zone", "n_name")


@add("map_algebra", ", t AS (SELECT cell_id, sum(value) AS x FROM layers GROUP BY 1) SELECT cell_id, round(value * x, 0) AS value FROM demand JOIN t USING (cell_id)")
def q(s, d):  # noqa: F811
    t = T.demand_layers(s, d).groupBy("cell_id").agg(F.sum("value").alias("value"))
    return _r(prep.map_algebra(T.demand(s, d), t), 0)


@add("stack_filter", "SELECT cell_id, round(sum(weight), 6) AS value FROM w GROUP BY 1 HAVING sum(weight) > 5")
def q(s, d):  # noqa: F811
    return _r(prep.stack_filter(_w(s, d), 5.0))


@add("percent_difference", ", z AS (SELECT zone, avg(value) AS v FROM demand JOIN zones USING (cell_id) GROUP BY 1) SELECT zone, round((v - first_value(v) OVER (ORDER BY zone)) / first_value(v) OVER (ORDER BY zone) * 100, 4) AS pct_diff FROM z")
def q(s, d):  # noqa: F811
    z = prep.zonal(T.demand(s, d), T.zones(s, d))
    return _r(prep.percent_difference(z, "zone", "mean").select("zone", "pct_diff"), 4)


@add("windowed_demand", "SELECT date_trunc('day', ts) AS window_start, user_id AS cell_id, round(sum(events.value), 4) AS value FROM events GROUP BY 1, 2")
def q(s, d):  # noqa: F811
    ev = T.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    return _r(windowed_demand(ev), 4).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("ranked_access", _access_sql(W15, STD, {"s_cap": "s_cap"}).replace("SELECT cell_id, round(sum(", ", a AS (SELECT cell_id, round(sum(") + "), z AS (SELECT a.cell_id, zone, s_cap, row_number() OVER (PARTITION BY zone ORDER BY s_cap DESC, a.cell_id) AS place FROM a JOIN zones ON zones.cell_id = a.cell_id) SELECT cell_id, zone, s_cap, place FROM z WHERE place <= 3")
def q(s, d):  # noqa: F811
    """A top-k report: the three best served cells of each zone."""
    a = _r(e2sfca(T.demand(s, d), T.supply(s, d), T.distance(s, d), G15, "standard", supply_cols=["s_cap"], validate=False).accessibility)
    place = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("s_cap"), "cell_id"))
    return a.join(T.zones(s, d), "cell_id").withColumn("place", place).filter("place <= 3").withColumn("place", F.col("place").cast("long"))
