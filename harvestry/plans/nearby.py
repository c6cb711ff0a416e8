"""Queries of the nearest markets by road."""

from __future__ import annotations

from harvestry.operators import cleaning
from harvestry.operators.nearest import nearest, nearest_prices, packed
from harvestry.plans.features import BASE
from harvestry.plans.registry import query, r, rounded_values
from harvestry.sources import adapters, scratch

# At scale 0.01 the SQL may look at every pair of markets.
NEAR = f"""m AS (SELECT s_suppkey AS mandi_id, 19.0::DOUBLE+s_suppkey%37/20.0::DOUBLE AS lat, 73.0::DOUBLE+s_suppkey%41/20.0::DOUBLE AS lon FROM supplier),
 roads AS (SELECT a.mandi_id, b.mandi_id AS other, {r("2*6371.0088*asin(sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))*1.3", 2)} AS road_km FROM m a JOIN m b ON a.mandi_id<>b.mandi_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY mandi_id ORDER BY road_km, other) AS rank FROM roads QUALIFY rank<=5)"""


@query(f"WITH {NEAR} SELECT mandi_id, other, road_km, rank FROM near")
def nearest_markets(spark, sf_dir):
    """The five nearest markets of each by road."""
    return nearest(adapters.mandis(spark, sf_dir), 5)


@query(f"""WITH {BASE}, {NEAR}, nm AS (SELECT near.mandi_id, f.obs_date, avg(f.price_now) AS p FROM near JOIN own f ON f.mandi_id=near.other WHERE f.days_since_observation<=7 GROUP BY 1,2)
SELECT mandi_id, obs_date, {r("p")} AS nbr_price_mean_k5, {r("CASE WHEN price_now>0 AND p>0 THEN ln(price_now/p) END")} AS price_vs_near FROM own LEFT JOIN nm USING (mandi_id, obs_date)""")
def nearest_price_means(spark, sf_dir):
    """Each market's price beside the mean of the five nearest by road, on all business days."""
    daily = cleaning.collapsed_series(adapters.raw_observations(spark, sf_dir))
    series = scratch.stored(packed(daily, cleaning.kept_rows), "series")
    rows = nearest_prices(series, nearest(adapters.mandis(spark, sf_dir), 5), each=rounded_values)
    return rows.select("mandi_id", "obs_date", "nbr_price_mean_k5", "price_vs_near")
