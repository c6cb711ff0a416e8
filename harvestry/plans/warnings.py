"""Queries of forecasts' coverage over time and of the glut regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.operators import evaluate, glut
from harvestry.plans.registry import DAILY, SERIES, daily, query, r, rounded
from harvestry.sources import adapters

BAND = "exp({s}{z}*sd*sqrt(horizon::DOUBLE))"


@query(f"""WITH {DAILY}, t AS (SELECT *, ln(modal_price)-lag(ln(modal_price)) OVER ({SERIES}) AS ret FROM daily),
 f AS (SELECT mandi_id, commodity_id, obs_date AS as_of, modal_price, CASE WHEN count(ret) OVER m>=2 THEN stddev_samp(ret) OVER m END AS sd FROM t WINDOW m AS ({SERIES} RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
 h AS (SELECT *, as_of+horizon AS t FROM f, (VALUES (1),(3),(7),(15)) h(horizon) WHERE sd IS NOT NULL),
 a AS (SELECT h.*, d.modal_price AS actual FROM h ASOF JOIN daily d ON h.commodity_id=d.commodity_id AND h.mandi_id=d.mandi_id AND h.t>=d.obs_date WHERE h.t-d.obs_date<=2 AND d.obs_date>h.as_of),
 c AS (SELECT commodity_id, horizon, t AS obs_date, count(*) AS n, count_if(actual BETWEEN modal_price*{BAND.format(s="-", z=evaluate.Z90)} AND modal_price*{BAND.format(s="", z=evaluate.Z90)}) AS hits FROM a GROUP BY 1,2,3),
 w AS (SELECT commodity_id, horizon, obs_date, sum(n) OVER o AS n, sum(hits) OVER o AS hits FROM c WINDOW o AS (PARTITION BY commodity_id, horizon ORDER BY obs_date RANGE BETWEEN INTERVAL 59 DAY PRECEDING AND CURRENT ROW))
SELECT commodity_id, horizon, obs_date, n::BIGINT AS n, {r("hits::DOUBLE/n")} AS picp, hits::DOUBLE/n<0.65 AS alert FROM w""")
def coverage_60d(spark, sf_dir):
    """Of every market's forecasts from each day with a price, how many held what came, over 60 days."""
    rows = daily(spark, sf_dir)
    settled = evaluate.settle_forecasts(evaluate.volatility_bands(rows), rows)
    return rounded(evaluate.rolling_coverage(settled, ["commodity_id", "horizon"]))


def _seasons(spark, sf_dir):
    """A quarter of a year in each nation: price and area from clean prices, rain from discounts, stock from the last month of the quarter before."""
    of = adapters.mandis(spark, sf_dir).select("mandi_id", F.col("district").alias("region"))
    season = lambda d: (F.year(d) * 4 + F.quarter(d) - 1).alias("season")
    late = F.sum(F.when(F.month("obs_date") % 3 == 0, F.col("arrival_qtl"))).alias("late")
    sold = daily(spark, sf_dir).join(of, "mandi_id").groupBy("commodity_id", "region", season(F.col("obs_date"))).agg(F.avg("modal_price").alias("price"), F.sum("arrival_qtl").alias("area"), late)
    lines = adapters.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("mandi_id"), season(F.col("l_shipdate").cast("date")), "l_discount")
    rain = lines.join(of, "mandi_id").groupBy("region", "season").agg((F.avg("l_discount") * 1000).alias("rain"))
    before = sold.select("commodity_id", "region", (F.col("season") + 1).alias("season"), F.col("late").alias("stock"))
    return sold.drop("late").join(rain, ["region", "season"]).join(before, ["commodity_id", "region", "season"], "left")


QUARTER = "(year({d})*4+quarter({d})-1)::INT"
SEASONS = f"""{DAILY}, q AS (SELECT n_name AS region, {QUARTER.format(d="obs_date")} AS season, avg(modal_price) AS price, sum(arrival_qtl) AS area, sum(CASE WHEN month(obs_date)%3=0 THEN arrival_qtl END) AS late FROM daily JOIN supplier ON s_suppkey=mandi_id JOIN nation ON n_nationkey=s_nationkey GROUP BY 1,2),
 ra AS (SELECT n_name AS region, {QUARTER.format(d="CAST(l_shipdate AS DATE)")} AS season, avg(l_discount)*1000 AS rain FROM lineitem JOIN supplier ON s_suppkey=l_suppkey JOIN nation ON n_nationkey=s_nationkey GROUP BY 1,2),
 sn AS (SELECT *, rain-avg(rain) OVER (PARTITION BY region, season%4) AS anomaly FROM q JOIN ra USING (region, season)),
 xs AS (SELECT s.region, s.season, s.price AS price, l.price AS price_last_year, ln(s.price) AS y, ln(s.area) AS x0, ln(b.area) AS x1, s.anomaly AS x2, ln(b.price) AS x3, ln(b.late)-ln(s.area) AS x4
  FROM sn s LEFT JOIN sn b ON b.region=s.region AND b.season=s.season-1 LEFT JOIN sn l ON l.region=s.region AND l.season=s.season-4)"""


def fitted_sql(where: str) -> str:
    """CTEs that fit rows of xs: sums of products, then the system's columns cleared one after the other."""
    n = len(glut.TERMS)
    sums = ", ".join([f"covar_pop(x{i},x{j}) AS a{i}_{j}" for i in range(n) for j in range(n)] + [f"covar_pop(x{i},y) AS a{i}_{n}, covar_pop(x{i},y) AS c{i}, avg(x{i}) AS m{i}, var_pop(x{i}) AS v{i}" for i in range(n)])
    out = f"e0 AS (SELECT region, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, {sums} FROM xs WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(n))} AND y IS NOT NULL AND {where} GROUP BY region)"
    for k in range(n):
        pivot = f"f{k} AS (SELECT *, CASE WHEN a{k}_{k}>1e-9*v{k} THEN a{k}_{k} END AS p{k} FROM e{k})"
        cells = ", ".join(f"a{k}_{j}/p{k} AS a{k}_{j}" if i == k else f"a{i}_{j}-a{i}_{k}*a{k}_{j}/p{k} AS a{i}_{j}" for i in range(n) for j in range(k + 1, n + 1))
        out += f", {pivot}, e{k + 1} AS (SELECT * REPLACE ({cells}) FROM f{k})"
    problem = f"CASE WHEN n<={n + 1} THEN 'too_few_rows' " + " ".join(f"WHEN p{k} IS NULL THEN 'dependent:{t}'" for k, t in enumerate(glut.TERMS)) + " END"
    out += f", g0 AS (SELECT *, {problem} AS problem, greatest(vy-({'+'.join(f'a{i}_{n}*c{i}' for i in range(n))}),0) AS rest FROM e{n})"
    good = lambda x: f"CASE WHEN problem IS NULL THEN {x} END"
    line = f"my-({'+'.join(f'a{i}_{n}*m{i}' for i in range(n))})"
    b = ", ".join(f"{good(f'a{i}_{n}')} AS b_{t}" for i, t in enumerate(glut.TERMS))
    return out + f", g AS (SELECT region, n, {good(line)} AS intercept, {b}, {good(f'sqrt(rest*n/(n-{n + 1}))')} AS sigma, {good('1-rest/CASE WHEN vy>0 THEN vy END')} AS r2, problem FROM g0)"


@query(f"""WITH {SEASONS}, {fitted_sql("true")} SELECT 1 AS commodity_id, region, n, {r("intercept")} AS intercept, {", ".join(f"{r('b_' + t)} AS b_{t}" for t in glut.TERMS)}, {r("sigma")} AS sigma, {r("r2")} AS r2, problem FROM g""")
def glut_regression(spark, sf_dir):
    """The coefficients of each region over all quarters."""
    return rounded(glut.fit(glut.season_rows(_seasons(spark, sf_dir))))


MIDDLE = "intercept+" + "+".join(f"b_{t}*x{i}" for i, t in enumerate(glut.TERMS))


@query(f"""WITH {SEASONS}, {fitted_sql("season<(SELECT max(season) FROM xs)")}, w AS (SELECT xs.region, season, {MIDDLE} AS mid, sigma, price_last_year AS was FROM xs LEFT JOIN g ON g.region=xs.region QUALIFY season=max(season) OVER (PARTITION BY xs.region))
SELECT 1 AS commodity_id, region, season, {r(f"exp(mid-{glut.Z90}*sigma)/was-1")} AS low, {r(f"exp(mid+{glut.Z90}*sigma)/was-1")} AS high, exp(mid)/was-1<=-0.05 AS warn FROM w""")
def glut_warnings(spark, sf_dir):
    """Each region's last quarter beside the year before, by coefficients of the quarters before; a fall of a twentieth warns, as these tables' prices move little."""
    rows = glut.season_rows(_seasons(spark, sf_dir))
    last = rows.agg(F.max("season").alias("end"))
    fits = glut.fit(rows.crossJoin(F.broadcast(last)).where("season < end"))  # one row
    return rounded(glut.warnings(rows, fits, fall=0.05))
