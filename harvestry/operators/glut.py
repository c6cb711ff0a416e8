"""Early warning of gluts: what a season's price does when more is sown.

A least-squares fit for each group from its covariances: one aggregate with partial sums, whatever the number of rows,
then the normal equations are solved in columns, for all groups at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["commodity_id", "region"]
TERMS = ["log_area", "log_area_before", "rain_anomaly", "log_price_before", "carryover"]
LEAST_PIVOT = 1e-9  # what the terms before leave of a term's variance; below, it counts as their combination
Z90 = 1.2815515655446004  # the normal distribution's 0.9 quantile


def least_squares(rows: DataFrame, by: list[str], y: str, terms: list[str]) -> DataFrame:
    """by, n, intercept, a column b_<term> for each term, sigma (the residuals' deviation), r2, problem.

    Rows with a null, a NaN or an infinity in y or a term are left out. problem is null, or `too_few_rows` (n is not above the number of
    coefficients), or `dependent:<term>` for the first term that is constant or a combination of those before it; the
    coefficients are null then. A group without a usable row gives no row. Null keys are a group like any other.

    The covariances are centred while they are summed, so large means cost no digits.
    """
    value = lambda c: F.col(c).cast("double")
    known = [~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")) for c in (y, *terms)]
    used = rows.select(*by, value(y).alias("y"), *(value(c).alias(f"x{i}") for i, c in enumerate(terms)), *(k.alias(f"k{i}") for i, k in enumerate(known)))
    for i in range(len(known)):
        used = used.where(F.col(f"k{i}"))
    n = len(terms)
    aggregates = [F.count("*").alias("n"), F.avg("y").alias("m_y"), F.var_pop("y").alias("v_y")]
    aggregates += [F.avg(f"x{i}").alias(f"m{i}") for i in range(n)] + [F.covar_pop(f"x{i}", "y").alias(f"c{i}") for i in range(n)]
    aggregates += [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}_{j}") for i in range(n) for j in range(i + 1)]
    sums = used.groupBy(*by).agg(*aggregates)
    # S = L D L': a step a column, each in its own projection, so that expressions stay short
    for j in range(n):
        d = F.col(f"s{j}_{j}") - sum((F.col(f"l{j}_{k}") ** 2 * F.col(f"d{k}") for k in range(j)), F.lit(0.0))
        sums = sums.withColumn(f"d{j}", F.when(d > LEAST_PIVOT * F.col(f"s{j}_{j}"), d))
        below = {f"l{i}_{j}": (F.col(f"s{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}") for k in range(j)), F.lit(0.0))) / F.col(f"d{j}") for i in range(j + 1, n)}
        z = F.col(f"c{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"z{k}") for k in range(j)), F.lit(0.0))
        sums = sums.withColumns(below | {f"z{j}": z})
    for j in reversed(range(n)):
        sums = sums.withColumn(f"b{j}", F.col(f"z{j}") / F.col(f"d{j}") - sum((F.col(f"l{i}_{j}") * F.col(f"b{i}") for i in range(j + 1, n)), F.lit(0.0)))
    problem = F.when(F.col("n") <= n + 1, "too_few_rows")
    for j, term in enumerate(terms):
        problem = problem.when(F.col(f"d{j}").isNull(), f"dependent:{term}")
    left = F.greatest(F.col("v_y") - sum((F.col(f"b{j}") * F.col(f"c{j}") for j in range(n)), F.lit(0.0)), F.lit(0.0))
    sums = sums.withColumns({"problem": problem, "left": left, "intercept": F.col("m_y") - sum((F.col(f"b{j}") * F.col(f"m{j}") for j in range(n)), F.lit(0.0))})
    good = lambda c: F.when(F.col("problem").isNull(), c)
    sigma, r2 = F.sqrt(F.col("left") * F.col("n") / (F.col("n") - n - 1)), 1 - F.col("left") / F.when(F.col("v_y") > 0, F.col("v_y"))
    return sums.select(*by, "n", good(F.col("intercept")).alias("intercept"), *(good(F.col(f"b{j}")).alias(f"b_{c}") for j, c in enumerate(terms)), good(sigma).alias("sigma"), good(r2).alias("r2"), "problem")


def season_rows(seasons: DataFrame, per_year: int = 4) -> DataFrame:
    """Each season with its terms: seasons has commodity_id, region, season (a running number), price, area, rain, stock, one row a season.

    log_area_before and log_price_before are those of the season just before, null where that one is missing. The rain's
    anomaly is its difference from the mean of the same season in all years; carryover is the log of stock over area.
    price_last_year is the price per_year seasons before. What isn't positive has no logarithm.
    """
    log = lambda c: F.when(F.col(c) > 0, F.ln(c))
    order = Window.partitionBy(*KEYS).orderBy("season")
    before = lambda c, k: F.max(c).over(order.rangeBetween(-k, -k))
    rows = seasons.withColumns({"log_price": log("price"), "log_area": log("area"), "rain_anomaly": F.col("rain") - F.avg("rain").over(Window.partitionBy(*KEYS, F.pmod("season", F.lit(per_year))))})
    return rows.withColumns({"log_area_before": before("log_area", 1), "log_price_before": before("log_price", 1), "carryover": log("stock") - F.col("log_area"), "price_last_year": before("price", per_year)})


def fit(rows: DataFrame) -> DataFrame:
    """The regression of each commodity and region: log price on TERMS; rows are those of season_rows()."""
    return least_squares(rows, KEYS, "log_price", TERMS)


def expected(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows with p10, p50, p90: the season's price as the regression has it, null where that has a problem or a term is missing."""
    joined = rows.join(fits.select(*(F.col(k).alias(f"of_{k}") for k in KEYS), "intercept", "sigma", *(f"b_{t}" for t in TERMS)), [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEYS], "left")
    mid: Column = F.col("intercept") + sum((F.col(f"b_{t}") * F.col(t) for t in TERMS), F.lit(0.0))
    wide = {p: F.exp(mid + z * F.col("sigma")) for p, z in (("p10", -Z90), ("p50", 0.0), ("p90", Z90))}
    return joined.withColumns(wide).select(*rows.columns, *wide)


def warnings(rows: DataFrame, fits: DataFrame, fall: float = 0.2) -> DataFrame:
    """commodity_id, region, season, low, high (the change to last year's price in the band from p10 to p90), warn: of each region's last season.

    warn is true where the middle of the band lies `fall` below last year's price, or more.
    """
    last = rows.groupBy(*KEYS).agg(F.max("season").alias("last")).select(*(F.col(k).alias(f"last_{k}") for k in KEYS), "last")
    at = rows.join(last, [F.col(k).eqNullSafe(F.col(f"last_{k}")) for k in KEYS] + [F.col("season") == F.col("last")], "left_semi")
    change = lambda c: F.col(c) / F.col("price_last_year") - 1
    return expected(at, fits).select(*KEYS, "season", change("p10").alias("low"), change("p90").alias("high"), (change("p50") <= -fall).alias("warn"))
