"""Readers of market data files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harvestry.config import ARRIVAL_UNITS, PRICE_UNITS
from harvestry.errors import ConfigError, IngestionError
from harvestry.functions import maths

# Spellings of headers, and date formats that are tried in this order.
HEADERS = {
    "obs_date": ("price date", "arrival date", "date", "reported date", "obs date"),
    "state": ("state", "state name"),
    "district": ("district", "district name"),
    "mandi": ("market", "market name", "mandi", "mandi name", "market centre"),
    "commodity": ("commodity", "commodity name"),
    "variety": ("variety", "variety name"),
    "grade": ("grade",),
    "min_price": ("min price", "min price rs quintal", "minimum price", "min_x0020_price"),
    "max_price": ("max price", "max price rs quintal", "maximum price", "max_x0020_price"),
    "modal_price": ("modal price", "modal price rs quintal", "modal_x0020_price"),
    "arrival": ("arrival", "arrivals", "arrival qty", "arrivals qty", "arrival tonnes", "arrivals in qtl", "quantity"),
}
DATE_FORMATS = ("d MMM yyyy", "d/M/yyyy", "yyyy-MM-dd", "d-M-yyyy", "M/d/yyyy", "d-MMM-yyyy")


def read_csv(spark: SparkSession, path: str | list[str], required: list[str] = (), comment: str | None = None) -> DataFrame:
    """CSV with a header, all columns as text; a row that doesn't fit keeps what could be read. path may be a pattern."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    df = reader.csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    if missing := [c for c in required if c not in df.columns]:
        raise ConfigError(f"columns {missing} are missing; there are {df.columns}")
    return df


def read_json_pages(spark: SparkSession, path: str, columns: list[str], records: str = "records") -> DataFrame:
    """Rows of landed JSON pages, each {records: [...]}, all columns as text; pages are files, so the folder is the cache."""
    row = StructType([StructField(c, StringType()) for c in columns])
    pages = spark.read.option("multiLine", True).schema(StructType().add(records, "string")).json(path)
    parsed = pages.select(F.explode(F.from_json(records, "array<" + row.simpleString() + ">")).alias("r"))
    return parsed.select("r.*")


def read_columnar_json(spark: SparkSession, path: str) -> DataFrame:
    """Weather payloads whose daily block holds parallel arrays: a row for each day; a missing array gives nulls."""
    daily = "daily struct<time:array<string>,precipitation_sum:array<double>,temperature_2m_max:array<double>,temperature_2m_min:array<double>>"
    payload = spark.read.option("multiLine", True).schema(f"mandi_id int, {daily}").json(path)
    return columnar_rows(payload)


def columnar_rows(payload: DataFrame) -> DataFrame:
    zipped = F.arrays_zip("daily.time", *(F.coalesce(f"daily.{c}", F.array().cast("array<double>")) for c in ("precipitation_sum", "temperature_2m_max", "temperature_2m_min")))
    rows = payload.select("mandi_id", F.explode(zipped).alias("d"))
    fields = rows.schema["d"].dataType.names
    return rows.select("mandi_id", F.col("d").getField(fields[0]).try_cast("date").alias("obs_date"), *(F.col("d").getField(f).alias(n) for f, n in zip(fields[1:], ("rainfall_mm", "tmax_c", "tmin_c"), strict=True)))


def read_table(spark: SparkSession, name: str, where: str | None = None, numeric: list[str] = (), **parameters) -> DataFrame:
    """A table or view, filtered by SQL with named parameters, with columns made numbers."""
    df = spark.sql(f"SELECT * FROM {name}" + (f" WHERE {where}" if where else ""), args=parameters)
    return df.withColumns({c: maths.number(F.col(c).cast("string")) for c in numeric})


def plain_header(name: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", name.lower())).strip()


def ratio(a: str, b: str) -> float:
    """Token-sort similarity of two short names, 0 to 100, for headers."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def detect_columns(headers: list[str], least: float = 88) -> dict[str, str]:
    """Canonical field -> header, by known spellings, then by similarity."""
    plain = {h: plain_header(h) for h in headers}
    found: dict[str, str] = {}
    for field, spellings in HEADERS.items():
        free = [h for h in headers if h not in found.values()]
        exact = [h for s in spellings for h in free if plain[h] == s]
        near = sorted(((max(ratio(plain[h], s) for s in spellings), h) for h in free), reverse=True)
        if exact:
            found[field] = exact[0]
        elif near and near[0][0] >= least:
            found[field] = near[0][1]
    if missing := [f for f in ("obs_date", "mandi", "commodity", "modal_price") if f not in found]:
        raise ConfigError(f"no column for {missing} among {headers}")
    return found


def detect_date_format(df: DataFrame, column: str, sample: int = 200, least: float = 0.95) -> str | None:
    """The first format that nearly all of some values have."""
    some = df.select(column).where(F.col(column).isNotNull()).limit(sample)
    shares = some.agg(*(F.avg(F.try_to_date(F.col(column), f).isNotNull().cast("double")).alias(f"f{i}") for i, f in enumerate(DATE_FORMATS))).first()
    return next((f for i, f in enumerate(DATE_FORMATS) if (shares[f"f{i}"] or 0) > least), None)


def normalise_units(df: DataFrame, price: str, arrival: str, prices=("min_price", "max_price", "modal_price"), arrivals=("arrival_qtl",)) -> DataFrame:
    """Prices for a quintal and arrivals in quintals; an unknown unit is an error."""
    if price not in PRICE_UNITS or arrival not in ARRIVAL_UNITS:
        raise IngestionError(f"unknown unit: {price} or {arrival}")
    number = lambda c, f: maths.number(F.col(c).cast("string")) * f
    return df.withColumns({c: number(c, PRICE_UNITS[price]) for c in prices} | {c: number(c, ARRIVAL_UNITS[arrival]) for c in arrivals})


def invalid_shocks(events: DataFrame) -> DataFrame:
    """Policy events whose direction, magnitude or decay isn't allowed."""
    good = F.col("direction").isin(-1, 1) & F.col("magnitude").isin(1, 2, 3) & (F.col("decay_days") > 0)
    return events.where(~F.coalesce(good, F.lit(False)))


# The columns of a file of policy events.
SHOCK_COLUMNS = ("event_date", "event_type", "commodity", "scope", "direction", "magnitude", "decay_days", "title", "source_url")


def read_shocks(spark: SparkSession, path: str, shown: int = 5) -> DataFrame:
    """Policy events of hand-written CSV files, with file and line; lines that begin with # are comments, an empty decay is 30 days.

    Raises IngestionError that names the first lines that aren't allowed. A value holds no line break; a file is one row at first, as
    only a whole file has line numbers.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")).alias("at", "text"))
    lines = whole.where("trim(text) <> '' and not ltrim(text) like '#%'").withColumn("line", F.col("at") + 1)
    heads = lines.groupBy("file").agg(F.min_by("text", "line").alias("head"), F.min("line").alias("first"))
    found = {tuple(c.strip() for c in r["head"].split(",")) for r in heads.select("head").distinct().limit(shown).collect()}
    if not found:
        raise IngestionError(f"{path} is empty: it needs a header at least")
    if len(found) > 1:
        raise IngestionError(f"the files of {path} have different headers")
    header = found.pop()
    missing = [c for c in SHOCK_COLUMNS if c not in header]
    if missing:
        raise IngestionError(f"{path} lacks the columns {missing}")
    parsed = F.from_csv("text", F.lit(", ".join(f"`{c}` string" for c in header)), {"mode": "PERMISSIVE", "escape": '"'})
    rows = lines.join(F.broadcast(heads.drop("head")), "file").where(F.col("line") > F.col("first")).select("file", "line", parsed.alias("p")).select("file", "line", *(F.trim(F.col("p")[c]).alias(c) for c in SHOCK_COLUMNS))
    number = lambda c: F.col(c).try_cast("int")
    decay = F.when(F.coalesce("decay_days", F.lit("")) == "", 30).otherwise(number("decay_days"))
    day = F.when(F.col("event_date").rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.col("event_date").try_cast("date"))
    events = rows.withColumns({"obs_date": day, "direction": number("direction"), "magnitude": number("magnitude"), "decay_days": decay})
    wrong = invalid_shocks(events).unionByName(events.where(F.col("obs_date").isNull())).select("file", "line").distinct().orderBy("file", "line").limit(shown).collect()
    if wrong:
        raise IngestionError("not allowed: " + ", ".join(f"{r['file']} line {r['line']}" for r in wrong))
    return events.drop("event_date")


def windows(start, end, months: int = 6) -> list[tuple]:
    """(from, to) of consecutive pulls that overlap by a day, so that a key's upsert removes what comes twice."""
    out = []
    while start <= end:
        month = start.month - 1 + months
        last = min(end, start.replace(year=start.year + month // 12, month=month % 12 + 1, day=min(start.day, 28)))
        out.append((start, last))
        if last == end:
            break
        start = last
    return out
