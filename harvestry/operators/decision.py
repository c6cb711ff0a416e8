"""Sell now or hold: candidates of every lot searched at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.config import GRADE_FACTOR, RISK_LAMBDA, SETTINGS, Decision
from harvestry.functions.maths import choose, clip
from harvestry.operators.economics import net_in_hand, spoilage_fraction


#: Parts that the markets are dealt into before the best of all are looked for.
PIECES = 32
RESULTS = ["fraction", "days", "now_mandi", "later_mandi", "p10", "p50", "p90", "e_net", "downside", "score", "constraints", "candidates"]


def holding_options(lots: DataFrame, cfg: Decision = SETTINGS.decision) -> DataFrame:
    """lots with days, one row for each allowed horizon; a fallback of 1 to 3 days where none is; and constraints."""
    days = F.array(*map(F.lit, cfg.hold_days))
    short = F.filter(days, lambda d: d <= cfg.max_hold_days)
    fresh = F.filter(short, lambda d: spoilage_fraction(d, F.col("storage")) <= cfg.max_spoilage)
    fallback = F.array(F.lit(max(1, min(3, cfg.max_hold_days))))
    names = F.array_compact(F.array(F.when(F.size(short) < len(cfg.hold_days), "max_hold_days"), F.when(F.size(fresh) == 0, "spoilage_cliff")))
    return lots.withColumn("constraints", names).withColumn("days", F.explode(F.when(F.size(fresh) > 0, fresh).otherwise(fallback)))


def options(mandis: DataFrame, forecasts: DataFrame, cfg: Decision = SETTINGS.decision, exposed: bool = False) -> DataFrame:
    """A row for each risk, small (load), fraction and days: the markets that can be best for some lot, today's and the later ones, and the number of all pairs.

    For a lot, a market's net is quantity x unit value - trucks x cost of the way, whatever the grade. So one that is no nearer
    than another and pays no more for a unit is never better, and goes; of equals the least id stays. That leaves few of any number of markets.
    Those at one distance go first, in one aggregate, so that not every market is multiplied by risks and fractions.
    """
    kept = 1 - (F.col("commission_pct") + F.col("cess_pct") + F.col("other_pct")) / 100
    near = lambda rows: rows.withColumn("small", F.explode(F.array(F.lit(False), F.lit(True)))).where(~F.col("small") | (F.col("distance_km") <= cfg.near_km))

    def market(unit: Column) -> Column:
        return F.struct("mandi_id", "distance_km", "price_now", "commission_pct", "cess_pct", "other_pct", unit.alias("unit"))

    def place(idle: bool, unit: Column, entry: Column, counts: Column, **names) -> Column:
        """Of the markets at one distance that which pays most for a unit, or if nothing is sold that with the least id; and how many there are."""
        top = F.min_by(entry, F.when(counts, F.struct("mandi_id"))) if idle else F.max_by(entry, F.when(counts, F.struct(unit, -F.col("mandi_id"))))
        return F.struct(*(F.lit(v).alias(c) for c, v in names.items()), F.lit(idle).alias("idle"), F.lit(0.0).alias("unit") if idle else F.max(F.when(counts, unit)).alias("unit"), top.alias("entry"), F.count_if(counts).alias("n"))

    def best_of(rows: DataFrame, keys: list[str], id_: str, name: str) -> DataFrame:
        totals = rows.groupBy(*keys).agg(F.sum("n").alias(f"n_{name}"))
        rows = rows.withColumn("piece", F.pmod(F.hash("distance_km"), F.lit(PIECES)))
        # In pieces first: what another one of its piece beats is not the best of all, so few are left for one group.
        for by in ([*keys, "piece"], keys):
            order = Window.partitionBy(*by).orderBy(F.when(F.col("idle"), 0.0).otherwise(F.col("distance_km")), -F.col("unit"), id_)
            rows = rows.withColumn("nearer", F.max("unit").over(order.rowsBetween(Window.unboundedPreceding, -1))).where("nearer is null or (not idle and unit > nearer)")
        return rows.groupBy(*keys).agg(F.collect_list("entry").alias(name)).join(totals, keys)

    unit = F.col("price_now") * kept
    today = mandis.groupBy("distance_km").agg(F.array(*(place(f == 0, unit, market(unit), F.lit(True), fraction=f) for f in cfg.sell_fractions)).alias("places"))
    now = best_of(near(today.select("distance_km", F.inline("places"))), ["small", "fraction"], "entry.mandi_id", "now")

    band = (F.col("p90") - F.col("p10")) / F.col("p50")
    share = kept - SETTINGS.costs.interest / 365 * F.col("days")

    def held(risk: str, penalty: float, f: float) -> Column:
        at_risk = 0.0 if f == 1 else penalty * (1 - f if exposed else 1.0)
        unit = share * (F.col("p50") - at_risk * F.greatest(F.lit(0.0), F.col("p50") - F.col("p10")))
        counts = F.lit(True) if f >= cfg.floor_fraction else ~F.coalesce(band > cfg.wide_band, F.lit(False))
        return place(f == 1, unit, F.struct(market(unit).alias("m"), "p10", "p50", "p90", band.alias("band")), counts, risk=risk, fraction=f)

    later = mandis.join(forecasts, "mandi_id").where(F.col("days").isin(_days(cfg))).groupBy("days", "distance_km")
    later = later.agg(F.array(*(held(risk, penalty, f) for risk, penalty in RISK_LAMBDA.items() for f in cfg.sell_fractions)).alias("places"))
    then = best_of(near(later.select("days", "distance_km", F.inline("places")).where("n > 0")), ["risk", "small", "fraction", "days"], "entry.m.mandi_id", "later")
    return then.join(now, ["small", "fraction"]).withColumn("candidates", F.col("n_now") * F.col("n_later"))


def _days(cfg: Decision) -> list[int]:
    return sorted({*cfg.hold_days, max(1, min(3, cfg.max_hold_days))})


#: What tells lots apart: those that have all of it in common have the same candidates and the same best one.
KIND = ["qty", "grade", "storage", "risk", "shock_now"]


def _kinds(lots: DataFrame) -> DataFrame:
    """Each kind of lot once, dealt anew: a row is short but its search is long, so tasks of many kinds must not be merged by their bytes. Few kinds are broadcast to the options."""
    return lots.select(*KIND).distinct().repartition(4 * lots.sparkSession.sparkContext.defaultParallelism, *KIND)


def _of_kind(lots: DataFrame, found: DataFrame) -> DataFrame:
    """lot_id of each lot with what was found for its kind; Spark broadcasts the kinds if they are small."""
    theirs = found.withColumnsRenamed({c: f"kind_{c}" for c in KIND})
    same = F.lit(True)
    for c in KIND:
        same = same & lots[c].eqNullSafe(theirs[f"kind_{c}"])
    return lots.select("lot_id", *KIND).join(theirs, same).drop(*theirs.columns[: len(KIND)])


def grid(lots: DataFrame, mandis: DataFrame, forecasts: DataFrame, cfg: Decision = SETTINGS.decision, exposed: bool = False, columns: list[str] = RESULTS) -> DataFrame:
    """For every lot, fraction and days the best of all pairs of markets: now_mandi, later_mandi, e_net, downside, score, and candidates, their number.

    mandis: mandi_id, distance_km, price_now, fees. forecasts: mandi_id, days, p10, p50, p90. Each sale pays the fees of its own
    market. The score is a part of today's market and a part of the later one, so each is chosen by itself (see `options`); Spark
    broadcasts the options if they are small. Hard rules: small loads go no further than near_km; wide bands and fresh bearish
    shocks (column shock_now of lots) set a least fraction to sell now. exposed: weights the risk by the share that is held.
    Lots of one kind are searched once. columns: those of the result besides the lot's own.
    """
    found = _search(_kinds(lots), mandis, forecasts, cfg, exposed).groupBy(*KIND).agg(F.collect_list(F.struct(*columns)).alias("cells"))
    return _of_kind(lots, found).select("lot_id", "qty", "grade", "storage", F.inline("cells"))


def _search(kinds: DataFrame, mandis: DataFrame, forecasts: DataFrame, cfg: Decision, exposed: bool) -> DataFrame:
    """KIND and RESULTS: a row for each kind of lot, fraction and days."""
    small = F.col("qty") < cfg.viable_load * SETTINGS.costs.truck_qtl
    rows = holding_options(kinds, cfg).withColumn("small", small).join(options(mandis, forecasts, cfg, exposed), ["risk", "small", "days"])
    rows = rows.where(~F.col("shock_now") | (F.col("fraction") >= 1.0))
    rows = rows.withColumn("now_qty", F.col("qty") * F.col("fraction")).withColumn("later_qty", F.col("qty") - F.col("now_qty")).withColumn("zero", F.lit(0)).withColumn("factor", choose(F.col("grade"), GRADE_FACTOR))
    rows = rows.withColumn("left", F.col("later_qty") * (1 - spoilage_fraction(F.col("days"), F.col("storage"))))

    def best(places: Column, market, left: Column) -> Column:
        handling = SETTINGS.costs.hamali + SETTINGS.costs.weighing + SETTINGS.costs.packing
        trucks = F.ceil(left / SETTINGS.costs.truck_qtl) * SETTINGS.costs.per_km
        scored = F.transform(places, lambda x: F.struct((left * (market(x)["unit"] * F.col("factor") - handling) - trucks * market(x)["distance_km"]).alias("s"), (-market(x)["mandi_id"]).alias("i"), x.alias("x")))
        return F.array_max(F.transform(scored, lambda y: F.struct(F.when(left > 0, y["s"]).otherwise(0.0).alias("s"), y["i"].alias("i"), y["x"].alias("x"))))["x"]

    rows = rows.withColumn("a", best(F.col("now"), lambda x: x, F.col("now_qty"))).withColumn("b", best(F.col("later"), lambda x: x["m"], F.col("left")))
    fees = ("commission_pct", "cess_pct", "other_pct")
    rows = rows.withColumns({"now_mandi": F.col("a.mandi_id"), "now_km": F.col("a.distance_km"), "price_now": F.col("a.price_now"), "later_mandi": F.col("b.m.mandi_id"), "later_km": F.col("b.m.distance_km"), **{q: F.col(f"b.{q}") for q in ("p10", "p50", "p90")}})
    rows = net_in_hand(rows.withColumns({c: F.col(f"a.{c}") for c in fees}), "price_now", "now_qty", "zero", "now_km", prefix="now_").withColumns({c: F.col(f"b.m.{c}") for c in fees})
    for q in ("p10", "p50"):
        rows = net_in_hand(rows, q, "later_qty", "days", "later_km", prefix=f"{q}_")
    paid = lambda q, c: F.when(F.col(q) > 0, F.col(c)).otherwise(0.0)
    rows = rows.withColumn("e_net", paid("now_qty", "now_net_total") + paid("later_qty", "p50_net_total")).withColumn("downside", F.greatest(F.lit(0.0), paid("later_qty", "p50_net_total") - paid("later_qty", "p10_net_total")))
    risk = choose(F.col("risk"), RISK_LAMBDA) * F.col("downside") * (F.col("later_qty") / F.col("qty") if exposed else F.lit(1.0))
    names = F.concat("constraints", F.array_compact(F.array(F.when(small, "min_viable_load"), F.when(F.col("b.band") > cfg.wide_band, "confidence_floor"), F.when(F.col("shock_now"), "shock_override"))))
    return rows.withColumn("score", F.col("e_net") - risk).withColumn("constraints", names).select(*KIND, *RESULTS)


def confidence(p10: Column, p50: Column, p90: Column, quality: Column, hits: Column, cfg: Decision = SETTINGS.decision) -> Column:
    tight = clip(1 - (p90 - p10) / (2 * p50) / cfg.band_scale, 0.0, 1.0)
    return cfg.weights[0] * tight + cfg.weights[1] * quality + cfg.weights[2] * hits


def _sold_today(rows: DataFrame, mandis: DataFrame) -> DataFrame:
    """rows (qty, grade, storage) with baseline_net: all sold today at the nearest market."""
    near = mandis.orderBy("distance_km", "mandi_id").limit(1)
    sold = net_in_hand(rows.crossJoin(F.broadcast(near)).withColumn("zero", F.lit(0)), "price_now", "qty", "zero")
    return sold.select(*rows.columns, F.col("net_total").alias("baseline_net"))


def baseline(lots: DataFrame, mandis: DataFrame) -> DataFrame:
    """lot_id, baseline_net: all sold today at the nearest market."""
    return _sold_today(lots.select("lot_id", "qty", "grade", "storage"), mandis).select("lot_id", "baseline_net")


def recommend(lots: DataFrame, mandis: DataFrame, forecasts: DataFrame, cfg: Decision = SETTINGS.decision, exposed: bool = False) -> DataFrame:
    """The best candidate of each lot, its action, gain, confidence and the number of candidates. Ties: the least fraction, days and ids.

    Lots of one kind have the same, so it is found for each kind and then given to each lot.
    """
    found = _search(_kinds(lots), mandis, forecasts, cfg, exposed)
    first = F.struct((-F.col("score")).alias("worse"), "fraction", "days", "now_mandi", "later_mandi")
    best = found.groupBy(*KIND).agg(F.min_by(F.struct(*RESULTS), first).alias("b"), F.sum("candidates").alias("considered")).select(*KIND, "b.*", "considered")
    action = F.when(F.col("fraction") == 0, "hold").when(F.col("fraction") == 1, "sell_now").otherwise("split")
    gain = F.col("e_net") - F.col("baseline_net")
    sure = confidence(F.col("p10"), F.col("p50"), F.col("p90"), F.lit(0.94), F.lit(0.79), cfg)
    best = _sold_today(best, mandis).withColumn("action", action).withColumn("expected_gain", gain).withColumn("confidence", sure)
    return _of_kind(lots, best).drop("risk", "shock_now")


def tranches(rows: DataFrame) -> DataFrame:
    """Recommendations with tranches array<struct(qtl, day_offset, mandi)>, rounded quantities, and a headline."""
    now = F.floor(F.col("qty") * F.col("fraction") + 0.5)
    later = F.floor(F.col("qty") - now + 0.5)
    part = lambda q, day, m: F.when(q > 0, F.struct(q.cast("long").alias("qtl"), day.cast("int").alias("day_offset"), m.alias("mandi")))
    lines = F.array_compact(F.array(part(now, F.lit(0), F.col("now_mandi")), part(later, F.col("days"), F.col("later_mandi"))))
    text = (
        F.when(F.col("action") == "split", F.format_string("Sell %d qtl today at %d, hold %d for %d days", now, "now_mandi", later, "days"))
        .when(F.col("action") == "sell_now", F.format_string("Sell all %d qtl today at %d", now, "now_mandi"))
        .otherwise(F.format_string("Hold all %d qtl for %d days", later, "days"))
    )
    return rows.withColumn("tranches", lines).withColumn("headline", text)


def reasons(attributions: Column, templates: Column, most: int = 2) -> Column:
    """The texts of the attributions (array<struct(name, weight)>) of greatest weight that have one, joined by `and`."""
    ranked = F.transform(F.array_sort(F.transform(attributions, lambda x: F.struct((-F.abs(x["weight"])).alias("w"), x["name"].alias("n")))), lambda x: F.element_at(templates, x["n"]))
    return F.array_join(F.slice(F.filter(ranked, lambda t: t.isNotNull()), 1, most), " and ")
