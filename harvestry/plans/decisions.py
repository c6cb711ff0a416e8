"""Queries of economics, decisions, forecasts and feedback."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions import strings
from harvestry.operators import decision, economics, evaluate, feedback
from harvestry.operators.asof import latest
from harvestry.operators.features import SERIES
from harvestry.plans.registry import DAILY, daily, query, r, rounded
from harvestry.sources import adapters, scratch

MANDIS = """fees AS (SELECT * FROM (VALUES ('Maharashtra',3.0,1.05,0.3),('_default',2.5,1.5,0.5)) t(st,commission_pct,cess_pct,other_pct)),
 md AS (SELECT s_suppkey AS mandi_id, CASE WHEN r_name='ASIA' THEN 'Maharashtra' ELSE r_name END AS st, (s_suppkey*7%120+3)::DOUBLE AS distance_km FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey),
 lt AS (SELECT mandi_id, arg_max(modal_price, obs_date) AS price_now FROM daily GROUP BY 1),
 m AS (SELECT md.mandi_id, distance_km, price_now, coalesce(f.commission_pct,d.commission_pct)::DOUBLE AS commission_pct, coalesce(f.cess_pct,d.cess_pct)::DOUBLE AS cess_pct, coalesce(f.other_pct,d.other_pct)::DOUBLE AS other_pct FROM md JOIN lt USING (mandi_id) LEFT JOIN fees f ON f.st=md.st JOIN fees d ON d.st='_default')"""
SPOIL = "(1-exp(-0.006*(CASE {s} WHEN 'ambient' THEN 1.0 WHEN 'shed' THEN 0.7 WHEN 'cold_store' THEN 0.25 END)*1.08*{d}))"
GRADE = "(CASE {g} WHEN 'A' THEN 1.1 WHEN 'B' THEN 1.0 WHEN 'C' THEN 0.86 END)"


def net(price: str, qty: str, days: str, km: str, grade: str, storage: str) -> str:
    """Net in hand in SQL, in one expression."""
    left = f"({qty}*(1-{SPOIL.format(s=storage, d=days)}))"
    gross = f"({price}*{left}*{GRADE.format(g=grade)})"
    return f"({gross}*(1-(commission_pct+cess_pct+other_pct)/100)-{left}*23-ceil({left}/90)*{km}*42-(CASE {storage} WHEN 'shed' THEN 0.6 WHEN 'cold_store' THEN 3.5 ELSE 0 END)*{qty}*{days}-{gross}*(0.14/365)*{days})"


def _mandis(spark, sf_dir):
    state = F.when(F.col("state") == "ASIA", "Maharashtra").otherwise(F.col("state"))
    base = adapters.mandis(spark, sf_dir).select("mandi_id", state.alias("state"), "distance_km")
    fees = economics.state_fees(base, economics.fee_table(spark))
    now = latest(daily(spark, sf_dir), ["mandi_id"], "obs_date", ["modal_price"]).select("mandi_id", F.col("modal_price").alias("price_now"))
    return fees.join(now, "mandi_id")


@query(f"""WITH {DAILY}, {MANDIS}, n AS (SELECT *, price_now AS gross_per_qtl, {net("price_now", "80.0", "0", "distance_km", "'B'", "'ambient'")}/80 AS net_per_qtl FROM m),
 k AS (SELECT *, row_number() OVER (ORDER BY gross_per_qtl DESC, mandi_id) AS rank_by_gross, row_number() OVER (ORDER BY net_per_qtl DESC, mandi_id) AS rank_by_net FROM n)
SELECT mandi_id, {r("gross_per_qtl")} AS gross_per_qtl, {r("net_per_qtl")} AS net_per_qtl, rank_by_gross, rank_by_net, rank_by_gross<>rank_by_net AS rank_flipped FROM k""")
def compare_markets(spark, sf_dir):
    """Markets by what a lot of 80 quintals would bring there."""
    lot = {"qty": F.lit(80.0), "days": F.lit(0), "grade": F.lit("B"), "storage": F.lit("ambient")}
    rows = economics.rank_markets(economics.net_in_hand(_mandis(spark, sf_dir).withColumns(lot), "price_now"))
    return rounded(rows.select("mandi_id", "gross_per_qtl", "net_per_qtl", "rank_by_gross", "rank_by_net", "rank_flipped"))


LOTS = """lots AS (SELECT o_orderkey AS lot_id, (o_orderkey%160+5)::DOUBLE AS qty, (['A','B','C'])[o_orderkey%3+1] AS grade, (['ambient','shed','cold_store'])[o_orderkey%7%3+1] AS storage, (['cautious','balanced','aggressive'])[o_orderkey%11%3+1] AS risk, o_orderkey%37=0 AS shock_now FROM orders)"""


def _lots(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return adapters.table(spark, sf_dir, "orders").select(
        k.alias("lot_id"), (k % 160 + 5).cast("double").alias("qty"), pick(("A", "B", "C"), k % 3).alias("grade"), pick(("ambient", "shed", "cold_store"), k % 7 % 3).alias("storage"), pick(("cautious", "balanced", "aggressive"), k % 11 % 3).alias("risk"), (k % 37 == 0).alias("shock_now")
    )


@query(f"WITH {LOTS} SELECT lot_id, d, {r(SPOIL.format(s='storage', d='d'), 6)} AS spoilage FROM lots, (VALUES (1),(3),(7),(15)) t(d)")
def spoilage_curve(spark, sf_dir):
    rows = _lots(spark, sf_dir).withColumn("d", F.explode(F.array(*map(F.lit, (1, 3, 7, 15)))))
    return rounded(rows.select("lot_id", "d", economics.spoilage_fraction(F.col("d"), F.col("storage")).alias("spoilage")), 6)


@query(f"""WITH {DAILY}, {MANDIS}, {LOTS}, x AS (SELECT lots.*, m.*, lot_id%16 AS days FROM lots JOIN m ON m.mandi_id=lot_id%100+1)
SELECT lot_id, {r(net("price_now", "qty", "days", "distance_km", "grade", "storage"), 3)} AS net_total, CASE WHEN (CASE storage WHEN 'ambient' THEN 0 ELSE 1 END)*days>0 OR days>0 THEN 7 ELSE 6 END AS n_lines FROM x""")
def net_breakdown(spark, sf_dir):
    """The sum of each lot's cost lines is its net."""
    rows = _lots(spark, sf_dir).withColumn("mandi_id", F.col("lot_id") % 100 + 1).withColumn("days", F.col("lot_id") % 16).join(_mandis(spark, sf_dir), "mandi_id")
    lines = economics.breakdown()
    out = economics.net_in_hand(rows, "price_now").select("lot_id", economics.waterfall_total(lines).alias("net_total"), F.size(lines).alias("n_lines"))
    return rounded(out, 3)


@query(f"""WITH p AS (SELECT o_custkey AS pool_id, max((o_custkey%120+3)::DOUBLE) AS km, count(*) AS k, sum((o_orderkey%40+5)::DOUBLE) AS q FROM orders GROUP BY 1)
SELECT pool_id, km*42 AS solo_cost, {r("km*42/k")} AS pooled_cost_each, {r("km*42-km*42/k")} AS saving_each, {r("(km*42-km*42/k)/(km*42)*100")} AS saving_pct, q AS total_qtl, {r("least(100.0,q/90.0*100)")} AS capacity_used_pct FROM p""")
def pool_economics(spark, sf_dir):
    members = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pool_id"), (F.col("o_custkey") % 120 + 3).cast("double").alias("distance_km"), (F.col("o_orderkey") % 40 + 5).cast("double").alias("qty"), F.lit(90.0).alias("truck_qtl"))
    return rounded(economics.pool_economics(members), 4, "pooled_cost_each", "saving_each", "saving_pct", "capacity_used_pct")


FAN = "fan AS (SELECT mandi_id, d AS days, price_now*(1+0.004*d)*(1-0.03*sqrt(d)) AS p10, price_now*(1+0.004*d) AS p50, price_now*(1+0.004*d)*(1+0.03*sqrt(d)) AS p90 FROM m, (SELECT unnest(range(1,16)) AS d))"


@query(f"WITH {DAILY}, {MANDIS}, {FAN} SELECT mandi_id, days, {r('p10')} AS p10, {r('p50')} AS p50, {r('p90')} AS p90 FROM fan")
def forecast_fan(spark, sf_dir):
    rows = evaluate.forecast_fan(_mandis(spark, sf_dir).select("mandi_id", "price_now"))
    return rounded(rows.select("mandi_id", F.col("days").cast("long").alias("days"), "p10", "p50", "p90"))


LATER = net("{p}", "(qty-qty*fr)", "d", "distance_km", "grade", "storage")
LAMBDA = "(CASE risk WHEN 'cautious' THEN 0.8 WHEN 'balanced' THEN 0.45 ELSE 0.2 END)"
GRIDS = f"""{LOTS}, fr AS (SELECT * FROM (VALUES (0.0::DOUBLE),(0.25),(0.5),(0.75),(1.0)) v(fr)),
 nows AS (SELECT lot_id, fr, count(*) AS n, arg_min({{'v': v, 'm': mandi_id}}, {{'v': -v, 'm': mandi_id}}) AS a FROM (SELECT lot_id, fr, mandi_id, CASE WHEN fr>0 THEN {net("price_now", "(qty*fr)", "0", "distance_km", "grade", "storage")} ELSE 0 END AS v
  FROM lots, fr, m WHERE (qty>=22.5 OR distance_km<=40) AND (fr=1 OR NOT shock_now)) GROUP BY 1,2),
 laters AS (SELECT lot_id, fr, d, count(*) AS n, arg_min({{'v': v, 's': s, 'm': mandi_id, 'a': p10, 'b': p50, 'c': p90}}, {{'s': -s, 'm': mandi_id}}) AS b FROM (SELECT *, v-{LAMBDA}*greatest(0,v-low) AS s FROM (SELECT lot_id, fr, d, risk, mandi_id, p10, p50, p90,
  CASE WHEN fr<1 THEN {LATER.format(p="p50")} ELSE 0 END AS v, CASE WHEN fr<1 THEN {LATER.format(p="p10")} ELSE 0 END AS low
  FROM lots, fr, (VALUES (3),(7),(15)) t(d), m JOIN fan USING (mandi_id) WHERE fan.days=d AND {SPOIL.format(s="storage", d="d")}<=0.15 AND (qty>=22.5 OR distance_km<=40)
   AND fr>=greatest(CASE WHEN (p90-p10)/p50>0.35 THEN 0.5 ELSE 0 END, CASE WHEN shock_now THEN 1.0 ELSE 0 END))) GROUP BY 1,2,3),
 scored AS (SELECT lot_id, fr AS fraction, d AS days, nows.n*laters.n AS candidates, a.m AS now_mandi, b.m AS later_mandi, b.a AS p10, b.b AS p50, b.c AS p90, a.v+b.v AS e_net, a.v+b.s AS score FROM nows JOIN laters USING (lot_id, fr))"""


@query(f"WITH {DAILY}, {MANDIS}, {FAN}, {GRIDS} SELECT lot_id, fraction, days, candidates, {r('score', 2)} AS best_score FROM scored")
def strategy_grid(spark, sf_dir):
    """The best pair of all markets for each lot, share sold now and days."""
    m = scratch.stored(_mandis(spark, sf_dir), "markets")
    found = decision.grid(_lots(spark, sf_dir), m, evaluate.forecast_fan(m.select("mandi_id", "price_now")), columns=["fraction", "days", "candidates", "score"])
    return rounded(found.select("lot_id", "fraction", "days", "candidates", F.col("score").alias("best_score")), 2, "best_score")


@query(f"""WITH {DAILY}, {MANDIS}, {FAN}, {GRIDS}, best AS (SELECT lot_id, arg_min({{'e': e_net, 'f': fraction, 'a': p10, 'b': p50, 'c': p90}}, {{'s': -score, 'f': fraction, 'd': days, 'n': now_mandi, 'l': later_mandi}}) AS z, sum(candidates)::BIGINT AS considered FROM scored GROUP BY 1),
 nearest AS (SELECT * FROM m ORDER BY distance_km, mandi_id LIMIT 1), base AS (SELECT lot_id, {net("price_now", "qty", "0", "distance_km", "grade", "storage")} AS baseline_net FROM lots, nearest)
SELECT lot_id, considered, CASE WHEN z.f=0 THEN 'hold' WHEN z.f=1 THEN 'sell_now' ELSE 'split' END AS action, {r("z.e", 2)} AS e_net, {r("baseline_net", 2)} AS baseline_net, {r("z.e-baseline_net", 2)} AS expected_gain,
 {r("0.5*least(greatest(1-(z.c-z.a)/(2*z.b)/0.3,0),1)+0.2*0.94+0.3*0.79")} AS confidence FROM best JOIN base USING (lot_id)""")
def recommend(spark, sf_dir):
    m = scratch.stored(_mandis(spark, sf_dir), "markets")
    rows = decision.recommend(_lots(spark, sf_dir), m, evaluate.forecast_fan(m.select("mandi_id", "price_now")))
    return rounded(rounded(rows.select("lot_id", "considered", "action", "e_net", "baseline_net", "expected_gain", "confidence"), 2, "e_net", "baseline_net", "expected_gain"), 4, "confidence")


BASELINES = f"""{DAILY}, bl AS (SELECT mandi_id, obs_date, modal_price AS naive, avg(modal_price) OVER (PARTITION BY mandi_id ORDER BY obs_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS ma7,
  CASE WHEN count(*) OVER mo>1 THEN regr_slope(modal_price,(obs_date-DATE '1970-01-01')::DOUBLE) OVER mo ELSE 0 END AS slope FROM daily WINDOW mo AS (PARTITION BY mandi_id ORDER BY obs_date RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)),
 b2 AS (SELECT *, obs_date+horizon-365 AS back FROM bl, (VALUES (1),(3),(7),(15)) h(horizon)),
 b3 AS (SELECT b2.mandi_id, b2.obs_date, horizon, naive, ma7, d.modal_price AS seasonal, naive+slope*horizon AS drift FROM b2 ASOF LEFT JOIN daily d ON b2.mandi_id=d.mandi_id AND b2.back>=d.obs_date)"""


@query(f"WITH {BASELINES} SELECT mandi_id, obs_date, horizon, {r('naive', 3)} AS naive, {r('ma7', 3)} AS ma7, {r('seasonal', 3)} AS seasonal, {r('drift', 3)} AS drift FROM b3")
def baseline_forecasts(spark, sf_dir):
    return rounded(evaluate.baselines(daily(spark, sf_dir)).select("mandi_id", "obs_date", "horizon", "naive", "ma7", "seasonal", "drift"), 3)


ACTUAL = f"""{BASELINES}, ac AS (SELECT b3.*, d.modal_price AS actual, 0.8*ma7 AS p10, ma7 AS p50, 1.2*ma7 AS p90 FROM b3 JOIN daily d ON d.mandi_id=b3.mandi_id AND d.obs_date=b3.obs_date+b3.horizon)"""


def _scored(spark, sf_dir):
    rows = daily(spark, sf_dir)
    b = evaluate.baselines(rows)
    target = rows.select("mandi_id", F.col("obs_date").alias("target"), F.col("modal_price").alias("actual"))
    joined = b.withColumn("target", F.date_add("obs_date", F.col("horizon"))).join(target, ["mandi_id", "target"])
    return joined.withColumns({"p10": 0.8 * F.col("ma7"), "p50": F.col("ma7"), "p90": 1.2 * F.col("ma7"), "price_now": F.col("naive")})


@query(f"""WITH {ACTUAL} SELECT horizon, {r("avg(abs(actual-p50)/actual*100)")} AS mape, {r("avg(2*abs(actual-p50)/(abs(actual)+abs(p50))*100)")} AS smape,
 {r("avg((greatest(0.1*(actual-p10),-0.9*(actual-p10))+greatest(0.5*(actual-p50),-0.5*(actual-p50))+greatest(0.9*(actual-p90),-0.1*(actual-p90)))/3)", 3)} AS pinball, {r("avg((actual BETWEEN p10 AND p90)::INT)")} AS picp,
 {r("avg((sign(actual-naive)=sign(p50-naive))::INT)")} AS directional, count(*) AS n FROM ac GROUP BY 1""")
def forecast_scores(spark, sf_dir):
    rows = evaluate.scores(_scored(spark, sf_dir), ["horizon"])
    return rounded(rounded(rows, 3, "pinball"), 4, "mape", "smape", "picp", "directional")


@query(f"WITH {ACTUAL} SELECT nominal, {r('avg((actual<=x)::INT)')} AS observed FROM (SELECT actual, unnest([{{'n': 0.1::DOUBLE, 'x': p10}}, {{'n': 0.5::DOUBLE, 'x': p50}}, {{'n': 0.9::DOUBLE, 'x': p90}}]) AS q FROM ac), LATERAL (SELECT q.n AS nominal, q.x AS x) GROUP BY 1")
def calibration(spark, sf_dir):
    return rounded(evaluate.calibration(_scored(spark, sf_dir)), 4, "observed")


@query(f"""WITH {DAILY}, d AS (SELECT DISTINCT obs_date AS as_of FROM daily), l AS (SELECT max(as_of) AS last FROM d), c AS (SELECT f AS fold, CAST(last - to_months((4-f)*3) AS DATE) AS s, CAST(last - to_months((3-f)*3) AS DATE) AS e FROM l, (VALUES (1),(2),(3)) t(f))
SELECT fold, CASE WHEN as_of>s AND as_of<=e THEN 'validate' ELSE 'train' END AS part, count(*) AS n, min(as_of) AS lo, max(as_of) AS hi FROM d, c WHERE (as_of>s AND as_of<=e) OR as_of<=s-7 GROUP BY ALL""")
def walk_forward_folds(spark, sf_dir):
    days = daily(spark, sf_dir).select(F.col("obs_date").alias("as_of")).distinct()
    return evaluate.folds(days).groupBy("fold", "part").agg(F.count("*").alias("n"), F.min("as_of").alias("lo"), F.max("as_of").alias("hi"))


@query(f"""WITH {DAILY}, lo AS (SELECT o_orderkey AS lot_id, o_custkey%100+1 AS mandi_id, CAST(o_orderdate AS DATE) AS as_of, o_orderkey%15+1 AS days FROM orders),
 a AS (SELECT lo.*, CASE WHEN as_of-d.obs_date<=2 THEN d.modal_price END AS p0 FROM lo ASOF LEFT JOIN daily d ON d.mandi_id=lo.mandi_id AND lo.as_of>=d.obs_date),
 b AS (SELECT a.*, as_of+days::INT AS t FROM a), c AS (SELECT b.*, CASE WHEN t-d.obs_date<=2 THEN d.modal_price END AS p1 FROM b ASOF LEFT JOIN daily d ON d.mandi_id=b.mandi_id AND b.t>=d.obs_date),
 g AS (SELECT strftime(as_of,'%Y-%m') AS ym, (p1-p0)/p0*100 AS gain_pct FROM c WHERE p0 IS NOT NULL AND p1 IS NOT NULL)
SELECT ym, {r("avg(gain_pct)")} AS mean, {r("quantile_cont(gain_pct,0.5)")} AS median, {r("quantile_cont(gain_pct,0.05)")} AS p5, {r("quantile_cont(gain_pct,0.95)")} AS p95, {r("avg((gain_pct>0)::INT)")} AS win_rate, count(*) AS n FROM g GROUP BY 1""")
def uplift_stats(spark, sf_dir):
    """Lots settled at what prices really were, by month."""
    lots = adapters.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lot_id"), F.lit(1).alias("commodity_id"), (F.col("o_custkey") % 100 + 1).alias("mandi_id"), F.col("o_orderdate").cast("date").alias("as_of"), (F.col("o_orderkey") % 15 + 1).cast("int").alias("days"))
    done = evaluate.settle(lots, daily(spark, sf_dir)).where("price_now is not null and price_later is not null")
    gain = (F.col("price_later") - F.col("price_now")) / F.col("price_now") * 100
    return rounded(evaluate.uplift(done.select(F.date_format("as_of", "yyyy-MM").alias("ym"), gain.alias("gain_pct")), ["ym"]))


REPORTS = """rp AS (SELECT o_orderkey AS report_id, o_custkey%25 AS mandi_id, o_custkey AS farmer_id, o_custkey%40 AS village, CAST(o_orderdate AS DATE) AS sale_date, o_orderkey%17+1.0 AS gap_pct, (o_orderkey%17+1)/100.0 AS gap, o_orderkey%3=0 AS followed, (['slip_photo','self_reported','fpo_verified'])[o_orderkey%5%3+1] AS verification FROM orders)"""


def _reports(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("slip_photo", "self_reported", "fpo_verified"))), (k % 5 % 3 + 1).cast("int"))
    return adapters.table(spark, sf_dir, "orders").select(
        k.alias("report_id"), (F.col("o_custkey") % 25).alias("mandi_id"), F.col("o_custkey").alias("farmer_id"), (F.col("o_custkey") % 40).alias("village"), F.col("o_orderdate").cast("date").alias("sale_date"),
        (k % 17 + 1).cast("double").alias("gap_pct"), ((k % 17 + 1) / 100).alias("gap"), (k % 3 == 0).alias("followed"), kind.alias("verification"),
    )


@query(f"""WITH {REPORTS}, g AS (SELECT mandi_id, count(*) AS reports, list_sort(list(gap_pct::DOUBLE))[count(*)//2+1] AS median_gap_pct FROM rp GROUP BY 1)
SELECT mandi_id, reports, median_gap_pct, {r("greatest(0,least(10,10-(median_gap_pct-6)*0.9))")} AS score, CASE WHEN median_gap_pct<11 THEN 'up' WHEN median_gap_pct>14 THEN 'down' ELSE 'flat' END AS trend FROM g""")
def transparency_demo(spark, sf_dir):
    return rounded(feedback.demo_scores(_reports(spark, sf_dir)), 4, "score")


@query(f"WITH {REPORTS} SELECT count(*) AS reports, count(DISTINCT farmer_id) AS farmers, count(DISTINCT village) AS villages, count_if(followed)::BIGINT AS followed, (list_sort(list(gap_pct::DOUBLE)))[count(*)//2+1] AS median_gap FROM rp")
def transparency_totals(spark, sf_dir):
    return feedback.totals(_reports(spark, sf_dir))


@query(f"""WITH {REPORTS}, x AS (SELECT * FROM rp WHERE sale_date>DATE '2000-12-31'-365 AND sale_date<=DATE '2000-12-31' QUALIFY row_number() OVER (PARTITION BY farmer_id, mandi_id, date_trunc('week',sale_date) ORDER BY sale_date DESC, report_id DESC)=1),
 c AS (SELECT x.*, unnest(range(0, CASE WHEN verification='self_reported' THEN 1 ELSE 3 END)) FROM x),
 t AS (SELECT mandi_id, quantile_cont(gap::DOUBLE,0.5) AS gap FROM (SELECT *, percent_rank() OVER (PARTITION BY mandi_id ORDER BY gap) AS p FROM c) WHERE p BETWEEN 0.1 AND 0.9 GROUP BY 1),
 o AS (SELECT quantile_cont(gap::DOUBLE,0.5) AS g FROM (SELECT *, percent_rank() OVER (ORDER BY gap) AS p FROM c) WHERE p BETWEEN 0.1 AND 0.9), n AS (SELECT mandi_id, count(*) AS n_reports FROM x GROUP BY 1),
 s AS (SELECT n.mandi_id, n_reports, gap, (n_reports*gap+15*g)/(n_reports+15) AS shrunk FROM n JOIN t USING (mandi_id), o)
SELECT mandi_id, n_reports, {r("gap")} AS raw_gap, {r("shrunk", 6)} AS shrunk_gap, CASE WHEN n_reports>=10 THEN {r("greatest(0,least(10,10*(1-shrunk/0.25)))")} END AS score FROM s""")
def transparency_score(spark, sf_dir):
    rows = feedback.transparency(_reports(spark, sf_dir), F.lit("2000-12-31").cast("date"), days=365)
    return rounded(rounded(rows, 6, "shrunk_gap"), 4, "raw_gap", "score")


@query(f"WITH {DAILY}, {MANDIS}, q AS (SELECT mandi_id, list_sort([price_now*(1+mandi_id%5/10.0::DOUBLE), price_now, price_now*(1-mandi_id%3/10.0::DOUBLE)]) AS z FROM m) SELECT mandi_id, {r('z[1]')} AS p10, {r('z[2]')} AS p50, {r('z[3]')} AS p90 FROM q")
def monotone_quantiles(spark, sf_dir):
    p = F.col("price_now")
    z = _mandis(spark, sf_dir).select("mandi_id", evaluate.monotone(p * (1 + F.col("mandi_id") % 5 / 10), p, p * (1 - F.col("mandi_id") % 3 / 10)).alias("z"))
    return rounded(z.select("mandi_id", *(F.element_at("z", i + 1).alias(c) for i, c in enumerate(("p10", "p50", "p90")))))


@query(f"""WITH {DAILY}, e AS (SELECT quantile_cont(modal_price,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS ed FROM daily WHERE obs_date<DATE '1999-01-01'),
 b AS (SELECT len(list_filter(ed, lambda x: x<modal_price)) AS bin, obs_date<DATE '1999-01-01' AS old FROM daily, e), s AS (SELECT bin, count_if(old)/sum(count_if(old)) OVER () AS expected, count_if(NOT old)/sum(count_if(NOT old)) OVER () AS actual FROM b GROUP BY 1)
SELECT bin::INT AS bin, {r("greatest(expected,1e-6)", 6)} AS expected, {r("greatest(actual,1e-6)", 6)} AS actual, {r("(greatest(actual,1e-6)-greatest(expected,1e-6))*ln(greatest(actual,1e-6)/greatest(expected,1e-6))", 6)} AS psi FROM s""")
def drift_psi(spark, sf_dir):
    rows = daily(spark, sf_dir)
    return rounded(evaluate.drift_psi(rows.where("obs_date < '1999-01-01'"), rows.where("obs_date >= '1999-01-01'"), "modal_price"), 6)


@query(f"""WITH {DAILY}, d AS (SELECT n_name AS district, obs_date, avg(modal_price) AS mean, max(modal_price) AS top, arg_max(mandi_id, {{'p': modal_price, 'm': -mandi_id}}) AS top_mandi, sum(arrival_qtl) AS arrivals FROM daily JOIN supplier ON s_suppkey=mandi_id JOIN nation ON n_nationkey=s_nationkey GROUP BY 1,2)
SELECT district, obs_date, {r("mean")} AS mean, {r("top")} AS top, top_mandi, arrivals FROM d""")
def district_prices(spark, sf_dir):
    m = adapters.mandis(spark, sf_dir).select("mandi_id", "district")
    rows = daily(spark, sf_dir).join(m, "mandi_id").groupBy("district", "obs_date").agg(F.avg("modal_price").alias("mean"), F.max("modal_price").alias("top"), F.max_by("mandi_id", F.struct("modal_price", -F.col("mandi_id"))).alias("top_mandi"), F.sum("arrival_qtl").alias("arrivals"))
    return rounded(rows, 4, "mean", "top")


@query(f"""WITH {DAILY}, c AS (SELECT mandi_id, arg_max(modal_price,obs_date) AS p, max(obs_date) AS d FROM daily GROUP BY 1), b AS (SELECT mandi_id, arg_max(modal_price,obs_date) AS q FROM daily JOIN c USING (mandi_id) WHERE obs_date<c.d GROUP BY 1),
 x AS (SELECT mandi_id, (p-q)/q*100 AS change FROM c JOIN b USING (mandi_id)) (SELECT 'gainer' AS kind, mandi_id, {r("change")} AS change FROM x ORDER BY x.change DESC, mandi_id LIMIT 3) UNION ALL (SELECT 'loser', mandi_id, {r("change")} FROM x ORDER BY x.change, mandi_id LIMIT 3)""")
def top_movers(spark, sf_dir):
    """The three markets that gained and lost most from one day to the next: a top-k report."""
    rows = daily(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("mandi_id").orderBy(F.desc("obs_date")))
    two = rows.select("mandi_id", "modal_price", rank.alias("back")).where("back <= 2").groupBy("mandi_id").agg(F.max(F.when(F.col("back") == 1, F.col("modal_price"))).alias("p"), F.max(F.when(F.col("back") == 2, F.col("modal_price"))).alias("q")).where("q is not null")
    x = two.select("mandi_id", ((F.col("p") - F.col("q")) / F.col("q") * 100).alias("change"))
    up = x.orderBy(F.desc("change"), "mandi_id").limit(3).select(F.lit("gainer").alias("kind"), "mandi_id", "change")
    return rounded(up.unionByName(x.orderBy("change", "mandi_id").limit(3).select(F.lit("loser").alias("kind"), "mandi_id", "change")))


@query("SELECT o_orderkey, CASE WHEN v>=1e7 THEN '₹'||printf('%.2f',floor(v/1e7*100+0.5)/100)||' Cr' WHEN v>=1e5 THEN '₹'||printf('%.2f',floor(v/1e5*100+0.5)/100)||' L' WHEN v>=1e3 THEN '₹'||printf('%.1f',floor(v/1e3*10+0.5)/10)||'K' ELSE '₹'||floor(v+0.5)::BIGINT::VARCHAR END AS text FROM (SELECT o_orderkey, (o_orderkey*o_orderkey*3)::DOUBLE AS v FROM orders)")
def compact_rupees(spark, sf_dir):
    v = (F.col("o_orderkey") * F.col("o_orderkey") * 3).cast("double")
    return adapters.table(spark, sf_dir, "orders").select("o_orderkey", strings.compact_rupees(v).alias("text"))


@query(f"""WITH {DAILY}, o AS (SELECT o_orderkey, o_custkey%100+1 AS mandi_id, CAST(o_orderdate AS DATE) AS obs_date, o_totalprice/100 AS price FROM orders)
SELECT o_orderkey, coalesce(price BETWEEN 0.3*modal_price AND 2.0*modal_price, false) AS plausible FROM o ASOF LEFT JOIN daily d ON o.mandi_id=d.mandi_id AND o.obs_date>=d.obs_date""")
def plausible_sales(spark, sf_dir):
    from harvestry.operators.asof import asof

    orders = adapters.table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("commodity_id"), (F.col("o_custkey") % 100 + 1).alias("mandi_id"), F.col("o_orderdate").cast("date").alias("obs_date"), (F.col("o_totalprice") / 100).alias("price"))
    found = asof(orders, daily(spark, sf_dir), SERIES, "obs_date", ["modal_price"])
    return found.select("o_orderkey", F.coalesce(feedback.plausible(F.col("price"), F.col("modal_price")), F.lit(False)).alias("plausible"))


