"""What a lot brings in hand: spoilage, fees, transport, holding, and markets ranked by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.config import GRADE_FACTOR, SETTINGS, STATE_FEES, STORAGE_COST, STORAGE_FACTOR, Costs
from harvestry.functions.maths import choose


def spoilage_fraction(days: Column, storage: Column, tmax: float | Column = 32.0, rate: float = SETTINGS.costs.spoilage_rate) -> Column:
    return 1 - F.exp(-rate * choose(storage, STORAGE_FACTOR) * (1 + 0.04 * F.greatest(F.lit(0.0), (F.lit(tmax) if isinstance(tmax, float) else tmax) - 30)) * days)


def state_fees(mandis: DataFrame, fees: DataFrame) -> DataFrame:
    """mandis with commission_pct, cess_pct, other_pct of their state, those of `_default` where it has none."""
    names = ["commission_pct", "cess_pct", "other_pct"]
    default = fees.where("fee_state = '_default'").select(*(F.col(c).alias(f"d_{c}") for c in names))
    joined = mandis.join(fees, mandis["state"] == fees["fee_state"], "left").crossJoin(F.broadcast(default))
    return joined.select(*mandis.columns, *(F.coalesce(c, f"d_{c}").alias(c) for c in names))


def fee_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in STATE_FEES.items()], "fee_state string, commission_pct double, cess_pct double, other_pct double")


def net_in_hand(rows: DataFrame, price: str = "price", qty: str = "qty", days: str = "days", km: str = "distance_km", grade: str = "grade", storage: str = "storage", pooled: str | None = None, prefix: str = "", cfg: Costs = SETTINGS.costs) -> DataFrame:
    """rows with gross, commission, cess, other, handling, transport, holding, net_total, net_per_qtl, gross_per_qtl.

    Fees come from columns commission_pct, cess_pct, other_pct. net_per_qtl is for a quintal of the original quantity.
    """
    p, q, d, k = (F.col(c).cast("double") for c in (price, qty, days, km))
    left = q * (1 - spoilage_fraction(d, F.col(storage), rate=cfg.spoilage_rate))
    out = rows.withColumn(f"{prefix}q_eff", left)
    left = F.col(f"{prefix}q_eff")
    out = out.withColumn(f"{prefix}gross", p * left * choose(F.col(grade), GRADE_FACTOR))
    gross = F.col(f"{prefix}gross")
    share = F.greatest(F.col(pooled), F.lit(1)) if pooled else F.lit(1)
    out = out.withColumns({
        f"{prefix}commission": gross * F.col("commission_pct") / 100, f"{prefix}cess": gross * F.col("cess_pct") / 100, f"{prefix}other": gross * F.col("other_pct") / 100,
        f"{prefix}handling": left * (cfg.hamali + cfg.weighing + cfg.packing), f"{prefix}transport": F.ceil(left / cfg.truck_qtl) * k * cfg.per_km / share,
        f"{prefix}holding": choose(F.col(storage), STORAGE_COST) * q * d + gross * (cfg.interest / 365) * d, f"{prefix}gross_per_qtl": p * choose(F.col(grade), GRADE_FACTOR),
    })
    costs = [F.col(f"{prefix}{c}") for c in ("commission", "cess", "other", "handling", "transport", "holding")]
    net = gross
    for c in costs:
        net = net - c
    return out.withColumn(f"{prefix}net_total", net).withColumn(f"{prefix}net_per_qtl", F.col(f"{prefix}net_total") / F.when(q > 0, q))


def breakdown(prefix: str = "") -> Column:
    """array<struct(label, amount, kind)>: the gross, then each deduction; holding only if there is one."""
    line = lambda label, c, kind, sign: F.struct(F.lit(label).alias("label"), (sign * F.col(f"{prefix}{c}")).alias("amount"), F.lit(kind).alias("kind"))
    lines = [line("Gross", "gross", "gross", 1), *(line(n, c, "deduction", -1) for n, c in (("Commission", "commission"), ("Market cess", "cess"), ("Other fees", "other"), ("Handling", "handling"), ("Transport", "transport"), ("Holding", "holding")))]
    return F.filter(F.array(*lines), lambda x: (x["label"] != "Holding") | (x["amount"] < 0))


def waterfall_total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0.0), lambda s, x: s + x["amount"])


def rank_markets(rows: DataFrame, by: list[str] = (), id_col: str = "mandi_id") -> DataFrame:
    """rank_by_gross, rank_by_net and rank_flipped in each group; ties by id."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rank = lambda c: F.row_number().over(w.orderBy(F.desc(c), id_col))
    out = rows.withColumn("rank_by_gross", rank("gross_per_qtl")).withColumn("rank_by_net", rank("net_per_qtl"))
    return out.withColumn("rank_flipped", F.col("rank_by_gross") != F.col("rank_by_net"))


def pool_economics(pools: DataFrame, cfg: Costs = SETTINGS.costs) -> DataFrame:
    """pool_id, solo_cost, pooled_cost_each, saving_each, saving_pct, total_qtl, capacity_used_pct; pools: a row for each member."""
    out = pools.groupBy("pool_id").agg(F.max("distance_km").alias("km"), F.count("*").alias("members"), F.sum("qty").alias("total_qtl"), F.max("truck_qtl").alias("truck"))
    solo, each = F.col("km") * cfg.per_km, F.col("km") * cfg.per_km / F.col("members")
    return out.select("pool_id", solo.alias("solo_cost"), each.alias("pooled_cost_each"), (solo - each).alias("saving_each"), ((solo - each) / solo * 100).alias("saving_pct"), "total_qtl", F.least(F.lit(100.0), F.col("total_qtl") / F.col("truck") * 100).alias("capacity_used_pct"))
