"""Tables of the data model, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harvestry.errors import ConfigError, FeatureSetMismatch

CANONICAL = ["obs_date", "mandi_id", "commodity_id", "variety", "grade", "min_price", "max_price", "modal_price", "arrival_qtl"]

# The tables' columns, as Spark DDL, and their keys.
TABLES = {
    "states": ("id int, name string, apmc_cess_pct decimal(5,3), commission_pct decimal(5,3), other_fees_pct decimal(5,3)", ["name"]),
    "mandis": ("id int, name string, normalised_name string, district string, state_id int, apmc_code string, lat double, lon double, is_enam boolean, active boolean", ["normalised_name", "district", "state_id"]),
    "commodities": ("id int, name string, variety string, crop_group string, perishability_class short, shelf_life_days int, msp_applicable boolean", ["name", "variety"]),
    "commodity_aliases": ("alias string, normalised_alias string, commodity_id int", ["alias"]),
    "msp_schedule": ("commodity_id int, season string, msp_per_qtl decimal(10,2), valid_from date, valid_to date", ["commodity_id", "season"]),
    "price_observations": ("obs_date date, mandi_id int, commodity_id int, variety string, grade string, min_price decimal(10,2), max_price decimal(10,2), modal_price decimal(10,2), arrival_qtl decimal(12,2), source string, is_imputed boolean, suspect boolean, raw string, ingested_at timestamp", ["obs_date", "mandi_id", "commodity_id", "variety", "grade"]),
    "weather_daily": ("obs_date date, mandi_id int, rainfall_mm decimal(6,2), tmax_c decimal(5,2), tmin_c decimal(5,2), humidity_pct decimal(5,2), is_forecast boolean", ["obs_date", "mandi_id"]),
    "shock_events": ("event_date date, event_type string, commodity_id int, scope string, direction short, magnitude short, source_url string, title string, decay_days int", ["event_date", "event_type", "commodity_id", "scope"]),
    "festivals": ("fest_date date, name string, demand_effect map<string,double>", ["fest_date"]),
    "distance_cache": ("from_lat decimal(9,4), from_lon decimal(9,4), to_lat decimal(9,4), to_lon decimal(9,4), road_km decimal(8,2), duration_min decimal(8,2), source string, cached_at timestamp", ["from_lat", "from_lon", "to_lat", "to_lon"]),
    "forecasts": ("issued_at timestamp, issued_for date, target_date date, horizon_days int, mandi_id int, commodity_id int, p10 decimal(10,2), p50 decimal(10,2), p90 decimal(10,2), model_version string, features_hash string", ["issued_for", "target_date", "mandi_id", "commodity_id", "model_version"]),
    "model_registry": ("version string, trained_at timestamp, train_start date, train_end date, algo string, params string, metrics string, is_active boolean, artifact_path string", ["version"]),
    "farmers": ("phone_e164 string, name string, language string, village string, lat double, lon double, home_mandi_id int, risk_profile string, fpo_id string, consent_at timestamp, created_at timestamp", ["phone_e164"]),
    "lots": ("id long, farmer_id long, commodity_id int, variety string, quantity_qtl decimal(10,2), remaining_qtl decimal(10,2), harvest_date date, quality_grade string, storage_type string, status string", ["id"]),
    "recommendations": ("id long, lot_id long, action string, sell_now_qtl decimal(10,2), hold_qtl decimal(10,2), hold_days int, target_mandi_id int, expected_net_now decimal(12,2), expected_net_strategy decimal(12,2), expected_gain decimal(12,2), confidence decimal(4,3), reason_text string, payload string", ["id"]),
    "sale_reports": ("id long, lot_id long, farmer_id long, recommendation_id long, sale_date date, mandi_id int, channel string, quantity_qtl decimal(10,2), gross_price_qtl decimal(10,2), net_received_qtl decimal(10,2), deductions_json string, followed_advice boolean, source string, verification string", ["id"]),
    "transparency_scores": ("mandi_id int, commodity_id int, window_end date, n_reports int, median_gap_pct decimal(6,3), shrunk_gap_pct decimal(6,3), score decimal(4,1)", ["mandi_id", "commodity_id", "window_end"]),
    "bot_sessions": ("phone string, state string, context string, updated_at timestamp", ["phone"]),
    "ingestion_runs": ("job string, started_at timestamp, ended_at timestamp, status string, rows_in long, rows_kept long, rows_rejected long, error string", ["job", "started_at"]),
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


def key(table: str) -> list[str]:
    return TABLES[table][1]


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if found := repeated(df, keys).take(1):
        raise ConfigError(f"a key occurs more than once: {found[0].asDict()}")
    return df


def assert_one_active(models: DataFrame) -> DataFrame:
    if models.where("is_active").limit(2).count() > 1:
        raise ConfigError("more than one model is active")
    return models


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def assert_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns must be these, in this order."""
    if df.columns != names:
        raise FeatureSetMismatch(f"missing {sorted(set(names) - set(df.columns))}, not known {sorted(set(df.columns) - set(names))}, or in another order")
    return df


def canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The canonical columns: renamed by field -> source column; those that the source lacks are null."""
    have = {f: df[c] if c in df.columns else F.lit(None) for f, c in mapping.items()}
    return df.select(*(have.get(c, F.lit(None)).alias(c) for c in CANONICAL))
