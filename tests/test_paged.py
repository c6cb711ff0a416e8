"""A paged endpoint read by batch and stream, against plain Python."""

import json
import threading
from collections import Counter
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException

from harvestry.errors import ConfigError
from harvestry.sources import paged

DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(200)]
ROWS = {
    "north": [{"id": str(i), "day": d.isoformat(), "price": str(10 + i)} for i, d in enumerate(DAYS)],
    "south": [{"id": f"s{i}", "day": d.isoformat(), "price": None} for i, d in enumerate(DAYS) if i % 3],
    "empty": [],
    "exact": [{"id": f"e{i}", "day": "2024-02-02", "price": "1", "more": {"a": i}} for i in range(20)],  # its last page is full
}
COLUMNS = ["id", "day", "price", "district", "window_start"]


class Endpoint(BaseHTTPRequestHandler):
    asked: Counter = Counter()
    broken: Counter = Counter()
    refuse = False
    keyword = False

    def _reply(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        key = "filters[district.keyword]" if self.keyword else "filters[district]"
        district, offset = q.get(key), int(q["offset"])
        self.asked[district, q["from"], offset] += 1
        if self.refuse:
            return self._reply(403, b"{}")
        if self.broken[district, offset] > 0:
            self.broken[district, offset] -= 1
            return self._reply(500, b"") if self.broken[district, offset] % 2 else self._reply(200, b"{broken")
        rows = [r for r in ROWS.get(district, []) if q["from"] <= r["day"] <= q["to"]]
        return self._reply(200, json.dumps({"records": rows[offset : offset + int(q["limit"])]}).encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.asked[body["district_id"], body["start_date"]] += 1
        rows = [r for r in ROWS[body["district_id"]] if body["start_date"] <= r["day"] <= body["end_date"]]
        self._reply(200, json.dumps({"data": rows}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Endpoint.asked, Endpoint.broken, Endpoint.refuse, Endpoint.keyword = Counter(), Counter(), False, False
    server = ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/prices"
    server.shutdown()


def options(url, at, **more):
    return {"url": url, "landing": str(at), "districts": list(ROWS), "from_": "2024-01-01", "to": "2024-07-18", "months": "2", "limit": "20", "waits": "0", **more}


def plain():
    """A row for each window that has the row's day; windows meet in a day."""
    out = []
    for a, b in paged.windows(date(2024, 1, 1), date(2024, 7, 18), 2):
        out += [(r["id"], r["day"], r["price"], d, a.isoformat()) for d, rows in ROWS.items() for r in rows if a.isoformat() <= r["day"] <= b.isoformat()]
    return sorted(out, key=str)


def test_batch_reads_all_pages_and_asks_again_only_for_what_is_missing(spark, url, tmp_path):
    Endpoint.broken.update({("north", 20): 2, ("south", 0): 1})
    df = paged.read_paged(spark, COLUMNS, **options(url, tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == plain()
    first = Counter(Endpoint.asked)
    assert first["exact", "2024-01-01", 20] == 1 and first["empty", "2024-01-01", 0] >= 1
    assert sorted(map(tuple, df.collect()), key=str) == plain()
    assert Endpoint.asked == first  # all landed
    next(p for p in tmp_path.iterdir() if "north_2024-03-01" in p.name and "000000020" in p.name).write_text("[{")
    assert sorted(map(tuple, df.collect()), key=str) == plain()
    assert (Endpoint.asked - first).total() <= 2 and (Endpoint.asked - first)["north", "2024-03-01", 20] == 1
    before = Counter(Endpoint.asked)
    paged.read_paged(spark, COLUMNS, **options(url, tmp_path, refresh="2024-07-02")).collect()
    assert {k[1] for k in Endpoint.asked - before} == {"2024-07-01"}
    Endpoint.refuse = True
    assert paged.read_paged(spark, COLUMNS, **options(url, tmp_path, offline="true")).count() == len(plain())


def test_other_names_of_filters_and_post(spark, url, tmp_path):
    Endpoint.keyword = True
    some = options(url, tmp_path / "k", districts=["north"])
    assert paged.read_paged(spark, COLUMNS, **some).count() == sum(r[3] == "north" for r in plain())
    Endpoint.keyword = False
    whole = paged.read_paged(spark, COLUMNS, **options(url, tmp_path / "p", method="post"))
    assert sorted(map(tuple, whole.collect()), key=str) == plain()


def test_faults(spark, url, tmp_path):
    Endpoint.broken.update({("north", 0): 99})
    with pytest.raises(PySparkException, match="3 attempts failed"):
        paged.read_paged(spark, COLUMNS, **options(url, tmp_path / "a", attempts="3")).count()
    Endpoint.broken.clear()
    with pytest.raises(PySparkException, match="more than 2 pages"):
        paged.read_paged(spark, COLUMNS, **options(url, tmp_path / "b", max_pages="2")).count()
    Endpoint.refuse = True
    with pytest.raises(PySparkException, match="refuses the key"):
        paged.read_paged(spark, COLUMNS, **options(url, tmp_path / "c")).count()
    with pytest.raises(PySparkException, match="no landed page"):
        paged.read_paged(spark, COLUMNS, **options(url, tmp_path / "d", offline="true")).count()
    with pytest.raises(ConfigError):
        paged.Pages({"url": url})


def test_stream_gives_the_same_rows_by_windows_that_are_over(spark, url, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run(until):
        stream = paged.read_paged(spark, COLUMNS, stream=True, **options(url, tmp_path / "pages", until=until))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(map(tuple, spark.read.parquet(out).collect()), key=str)

    assert run("2024-05-01") == [r for r in plain() if r[4] < "2024-05-01"]
    asked = Counter(Endpoint.asked)
    assert run("2024-07-18") == plain()
    assert all(k[1] >= "2024-05-01" for k in Endpoint.asked - asked)


def test_landed_pages_are_read_to_their_end(spark, tmp_path):
    day, landing = date(2024, 1, 2), f"file://{tmp_path}/landed"
    rows = spark.createDataFrame([(i, "A", day) for i in range(6)], "id int, d string, day date")
    paged.land(rows, landing, "http://localhost/x", "d", "day", ["id"], ["A", "B"], date(2024, 1, 1), date(2024, 3, 31), limit=2)
    got = paged.read_paged(spark, ["id"], url="http://localhost/x", landing=landing, districts=["A", "B"], from_="2024-01-01", to="2024-03-31", limit=2, max_pages=1, offline="true")
    assert sorted(r["id"] for r in got.collect()) == list("012345")
