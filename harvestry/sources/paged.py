"""Rows of an HTTP endpoint that gives pages, as a Spark data source.

A partition is one district and one window of days. Its task asks for page after page until a short one and lands each
page as a file in a shared folder before its rows go on, so a run that broke off, or a task that is run again, asks only
for what isn't there. As a stream, an offset is the number of windows that are over.
"""

from __future__ import annotations

import itertools
import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from harvestry.errors import ConfigError, IngestionError
from harvestry.sources.readers import windows

REFUSED = (401, 403)  # a wrong key; asking again doesn't help


@dataclass
class Part(InputPartition):
    district: str
    start: str
    end: str


class Landing:
    """Pages as files: one for each endpoint, district, window and offset. A page appears only when it is whole."""

    def __init__(self, uri: str, endpoint: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))
        self.endpoint = re.sub(r"\W+", "-", endpoint.rstrip("/").rsplit("/", 1)[-1])

    def path(self, part: Part, offset: int) -> str:
        return f"{self.folder}/{self.endpoint}_{urllib.parse.quote(part.district, safe='')}_{part.start}_{part.end}_{offset:09d}.json"

    def get(self, part: Part, offset: int) -> list[dict] | None:
        """The landed records, or None if there is no such page or it can't be read."""
        path = self.path(part, offset)
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(path) as source:
            try:
                rows = json.loads(source.read().decode())
            except ValueError:
                return None
        return rows if isinstance(rows, list) else None

    def put(self, part: Part, offset: int, rows: list[dict]) -> None:
        path = self.path(part, offset)
        beside = f"{path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.folder, recursive=True)
        with self.fs.open_output_stream(beside) as out:
            out.write(json.dumps(rows).encode())
        self.fs.move(beside, path)


class Pages:
    """The pages of one source, by its options.

    url, landing: where to ask, where to keep. districts: a JSON list. from, to, months: the days, in windows of so many months that
    overlap by a day. method: get asks for pages by offset and limit, post for a whole window. limit: rows of a full page; max_pages: of a window,
    more are an error, so that no row is lost. filters: a JSON object; keyword_suffix: put behind their names if the first page is empty.
    records: where a reply has its rows. attempts, waits: how often to ask, seconds between. refresh: windows that end on this day or later are asked
    for again. offline: only what has landed. until: as a stream, the windows that end up to this day.
    """

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        if missing := [k for k in ("landing", "districts", "from", "to") if k not in o]:
            raise ConfigError(f"options {missing} are missing")
        self.offline = o.get("offline", "false").lower() == "true"
        self.url = o.get("url") or o.get("path") or ""
        if not self.url:
            raise ConfigError("option url is missing")
        self.landing_uri = o["landing"]
        self.districts = [str(d) for d in json.loads(o["districts"])]
        self.windows = [(a.isoformat(), b.isoformat()) for a, b in windows(date.fromisoformat(o["from"]), date.fromisoformat(o["to"]), int(o.get("months", "6")))]
        self.post = o.get("method", "get").lower() == "post"
        self.limit, self.max_pages = int(o.get("limit", "1000")), int(o.get("max_pages", "200"))
        self.filters, self.suffix = json.loads(o.get("filters", "{}")), o.get("keyword_suffix", ".keyword")
        self.records = o.get("records", "data" if self.post else "records")
        self.attempts, self.waits = int(o.get("attempts", "5")), [float(x) for x in o.get("waits", "1,2,4,8").split(",")]
        self.timeout, self.refresh, self.until = float(o.get("timeout", "60")), o.get("refresh"), o.get("until")

    def parts(self, first: int = 0, last: int | None = None) -> list[Part]:
        return [Part(d, a, b) for a, b in self.windows[first:last] for d in self.districts]

    def over(self) -> int:
        """The number of windows that are over."""
        until = self.until or date.today().isoformat()
        return sum(b <= until for _, b in self.windows)

    def _request(self, part: Part, offset: int, suffix: str) -> urllib.request.Request:
        if self.post:
            body = {**self.filters, "district_id": part.district, "start_date": part.start, "end_date": part.end}
            return urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        query = {"format": "json", "limit": self.limit, "offset": offset, "from": part.start, "to": part.end}
        query |= {f"filters[{k}{suffix}]": v for k, v in {**self.filters, "district": part.district}.items()}
        return urllib.request.Request(f"{self.url}?{urllib.parse.urlencode(query)}")

    def _ask(self, part: Part, offset: int, suffix: str) -> list[dict]:
        """The records of one page. Raises IngestionError when no attempt succeeds."""
        error = ""
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.waits[min(attempt - 1, len(self.waits) - 1)])
            try:
                with urllib.request.urlopen(self._request(part, offset, suffix), timeout=self.timeout) as reply:
                    rows = json.loads(reply.read().decode()).get(self.records) or []
                if not isinstance(rows, list):
                    raise ValueError(f"{self.records} is no list")
                return rows
            except urllib.error.HTTPError as e:
                if e.code in REFUSED:
                    raise IngestionError(f"{self.url} refuses the key: HTTP {e.code}") from e
                error = f"HTTP {e.code}"
            except (OSError, ValueError, AttributeError) as e:
                error = f"{type(e).__name__}: {e}"
        raise IngestionError(f"{self.url}: {self.attempts} attempts failed for {part} at {offset}: {error}")

    def read(self, part: Part) -> Iterator[list[dict]]:
        """The pages of one district and window, landed first."""
        landing, suffix = Landing(self.landing_uri, self.url), None
        known = self.offline or not (self.refresh and part.end >= self.refresh)
        # Landed pages end by themselves, however many they are.
        for page in itertools.count() if self.offline else range(self.max_pages + 1):
            offset = page * self.limit
            rows = landing.get(part, offset) if known else None
            if rows is None:
                if self.offline:
                    raise IngestionError(f"no landed page for {part} at {offset}")
                if suffix is None:
                    # after landed pages: by which names they came
                    suffix = "" if not page or self._ask(part, 0, "") else self.suffix
                rows = self._ask(part, offset, suffix)
                if not rows and not page and not self.post and self.suffix:
                    # some endpoints know the filters by other names only
                    rows = self._ask(part, offset, self.suffix)
                    suffix = self.suffix if rows else ""
                if page < self.max_pages:
                    landing.put(part, offset, rows)
            if page == self.max_pages and rows and not self.offline:
                raise IngestionError(f"more than {self.max_pages} pages for {part}: use shorter windows")
            yield rows
            if self.post or len(rows) < self.limit:
                return


def _tuples(pages: Pages, schema: StructType, part: Part) -> Iterator[tuple]:
    own = {"district": part.district, "window_start": part.start}
    text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v)
    for rows in pages.read(part):
        for row in rows:
            yield tuple(text(row.get(c)) if c in row else own.get(c) for c in schema.fieldNames())


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages, schema: StructType):
        self.pages, self.schema = pages, schema

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages.parts()

    def read(self, partition: Part) -> Iterator[tuple]:
        return _tuples(self.pages, self.schema, partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, pages: Pages, schema: StructType):
        self.pages, self.schema = pages, schema

    def initialOffset(self) -> dict:
        return {"windows": 0}

    def latestOffset(self) -> dict:
        return {"windows": self.pages.over()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.pages.parts(start["windows"], end["windows"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return _tuples(self.pages, self.schema, partition)


class PagedSource(DataSource):
    """Format `paged`. The schema names the records' fields, all as text; district and window_start are those of the partition."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ConfigError("a schema must be given, all columns as text")

    def _checked(self, schema: StructType) -> StructType:
        if other := [f.name for f in schema.fields if f.dataType.simpleString() != "string"]:
            raise ConfigError(f"columns {other} must be text")
        return schema

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(Pages(self.options), self._checked(schema))

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(Pages(self.options), self._checked(schema))


def read_paged(spark: SparkSession, columns: list[str], stream: bool = False, **options: object) -> DataFrame:
    """Rows of a paged endpoint, or a stream of them; the options are those of Pages."""
    spark.dataSource.register(PagedSource)
    text = {k.rstrip("_"): v if isinstance(v, str) else json.dumps(v) for k, v in options.items()}
    reader = (spark.readStream if stream else spark.read).format("paged").schema(", ".join(f"`{c}` string" for c in columns))
    return reader.options(**text).load()


def land(rows: DataFrame, landing: str, url: str, district: str, day: str, order: list[str], districts: list[str], start: date, end: date, months: int = 6, limit: int = 1000) -> None:
    """Lands rows as the pages that an endpoint would have given for them; windows without rows get an empty page.

    A day on which two windows meet is in both, as it is when they are asked for.
    """
    spark = rows.sparkSession
    spans = windows(start, end, months)
    table = spark.createDataFrame([(d, a, b) for d in districts for a, b in spans], "__district string, __start date, __end date")
    record = F.struct(*(F.col(c).cast("string").alias(c) for c in rows.columns))
    met = table.join(rows.withColumn("__r", record), (F.col("__district") == F.col(district).cast("string")) & F.col(day).between(F.col("__start"), F.col("__end")), "left")
    w = Window.partitionBy("__district", "__start", "__end").orderBy(*order)
    # The last row of a window is found among rows, so that no task holds all pages of one.
    met = met.withColumn("__page", F.floor((F.row_number().over(w) - 1) / limit)).withColumn("__ends", F.lead(F.lit(1)).over(w).isNull())
    page = met.groupBy("__district", "__start", "__end", "__page").agg(F.to_json(F.collect_list("__r")).alias("__records"), F.max("__ends").alias("__ends"))

    def write(found: Iterator) -> None:
        to = Landing(landing, url)
        for r in found:
            part, records = Part(r["__district"], r["__start"].isoformat(), r["__end"].isoformat()), json.loads(r["__records"])
            to.put(part, r["__page"] * limit, records)
            if len(records) == limit and r["__ends"]:
                to.put(part, (r["__page"] + 1) * limit, [])  # what follows a full last page

    page.foreachPartition(write)
