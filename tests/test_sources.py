import json
import threading
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemill.sources import files, paths
from tidemill.sources.contracts import ContractError, convert, pointer_path, project_json, schema_of
from tidemill.sources.pages import PagedSource, at_pointer, fetch_each


def test_csv_contract_guards_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    assert files.read_files(spark, "csv", str(tmp_path), {"id": "int", "name": "varchar"}).count() == 2
    with pytest.raises(Exception):
        files.read_files(spark, "csv", str(tmp_path), {"name": "varchar", "id": "int"}).collect()
    with pytest.raises(files.FormatError):
        files.read_files(spark, "csv", str(tmp_path), layout="array")
    with pytest.raises(files.FormatError):
        files.read_files(spark, "csv", str(tmp_path), delimiter="||")
    with pytest.raises(files.FormatError):
        files.read_files(spark, "orc2", str(tmp_path))


def test_json_layouts_and_pointers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=1))
    assert files.read_files(spark, "json", str(tmp_path), {"id": "bigint"}, layout="array").count() == 2
    assert pointer_path("/a/0/b~1c") == "$['a'][0]['b/c']"
    df = spark.createDataFrame([('{"a": {"b": [5, 6]}, "t": 1500}',), ("{}",), (None,)], "p string")
    got = project_json(df, "p", {"x": ("/a/b/1", "int"), "y": ("/a/z", "varchar")}).collect()
    assert [tuple(r) for r in got] == [(6, None), (None, None), (None, None)]
    at = df.select(convert(F.get_json_object("p", "$.t"), "timestamp", "ms").alias("t")).first().t
    assert at == datetime(1970, 1, 1, 0, 0, 1, 500000)
    with pytest.raises(ContractError):
        schema_of({"a": "text"})


def test_write_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_files(spark.range(5).toDF("id"), "parquet", path)
    files.write_files(spark.range(5).toDF("id"), "parquet", path)
    assert spark.read.parquet(path).count() == 10
    files.write_files(spark.read.parquet(path).where("id < 2"), "parquet", path, "replace")
    assert spark.read.parquet(path).count() == 4
    assert not [p for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name]
    with pytest.raises(files.FormatError):
        files.write_files(spark.range(1), "avro", path)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "a\nb\n")
        z.writestr("y.txt", "no")
    assert [r.line for r in files.read_archives(spark, str(tmp_path / "a.zip"), "*.csv").orderBy("line").collect()] == ["a", "b"]


def test_path_cover():
    t = "d/{yyyy}/{MM}/{dd}"
    assert paths.cover(t, datetime(2023, 12, 30), datetime(2024, 2, 1)) == ["d/2023/12/30", "d/2023/12/31", "d/2024/01/*", "d/2024/02/01"]
    assert paths.cover(t, datetime(2024, 1, 1), datetime(2024, 12, 31)) == ["d/2024/*/*"]
    assert paths.cover("d/{dd}", datetime(2024, 1, 1), datetime(2024, 1, 2)) == ["d/*"]
    assert paths.cover("d", datetime(2024, 1, 1), datetime(2024, 1, 2)) == ["d"]
    assert paths.render("{yyyy}-{HH}{mm}", datetime(2024, 1, 1, 5, 7)) == "2024-0507"


class Service(BaseHTTPRequestHandler):
    busy = 1
    got = []

    def do_GET(self):
        from urllib.parse import parse_qsl, urlsplit

        q, kind = dict(parse_qsl(urlsplit(self.path).query)), urlsplit(self.path).path.strip("/")
        if Service.busy:
            Service.busy -= 1
            self.send_response(503)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        at = {"page": (int(q.get("page", 1)) - 1) * 3, "offset": int(q.get("offset", 0))}.get(kind, int(q.get("cursor", 0)))
        items = [{"id": k, "n": {"v": f"x{k}"}} for k in range(at, min(at + 3, 8))]
        after = at + 3 if at + 3 < 8 else None
        body = {"items": items, "next": (f"/next_url?cursor={after}" if kind == "next_url" else after) if after else None}
        self.send_response(200)
        if kind == "link" and after:
            self.send_header("Link", f'</link?cursor={after}>; rel="next"')
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        Service.got.append((self.command, self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
        self.send_response(200)
        self.end_headers()

    do_PUT = do_POST

    def log_message(self, *_):
        pass


@pytest.mark.parametrize("paging", ["page", "offset", "cursor", "next_url", "link"])
def test_paged_service(spark, paging):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    columns = json.dumps({"id": ["/id", "bigint"], "v": ["/n/v", "varchar"], "none": ["/q", "int"]})
    url = f"http://127.0.0.1:{server.server_port}/{paging}"
    read = spark.read.format("pages").option("url", url).option("paging", paging).option("items", "/items").option("columns", columns)
    assert sorted((r.id, r.v, r.none) for r in read.load().collect()) == [(k, f"x{k}", None) for k in range(8)]
    if paging in ("page", "offset"):
        assert read.option("pages", 3).option("size", 3).load().count() == 8
    with pytest.raises(Exception, match="newest first"):
        read.option("stop_pointer", "/id").option("stop_at", -1).load().collect()
    server.shutdown()


def test_requests_for_each_row_and_writes(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedSource)
    url = f"http://127.0.0.1:{server.server_port}"
    keys = spark.createDataFrame([(0,), (3,), (99,)], "at long")
    got = fetch_each(keys, url + "/cursor?cursor={at}", {"id": ("/id", "bigint"), "v": ("/n/v", "varchar")}, "/items")
    assert sorted(map(tuple, got.collect())) == [(0, 0, "x0"), (0, 1, "x1"), (0, 2, "x2"), (3, 3, "x3"), (3, 4, "x4"), (3, 5, "x5")]
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(5)], "id long, v string").coalesce(1)
    rows.write.format("pages").mode("append").option("url", url + "/in").option("size", 2).save()
    assert [len(body) for _, _, body in Service.got] == [2, 2, 1] and Service.got[0][2][0] == {"id": 0, "v": "v0"}
    Service.got.clear()
    rows.limit(1).write.format("pages").mode("append").option("url", url + "/in/{id}").option("method", "PUT").save()
    assert Service.got == [("PUT", "/in/0", {"id": 0, "v": "v0"})]
    server.shutdown()


def test_at_pointer():
    assert at_pointer({"a": [1, {"b~/": 2}]}, "/a/1/b~0~1") == 2 and at_pointer({"a": 1}, "/a/b") is None
