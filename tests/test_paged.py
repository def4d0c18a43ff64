"""The paged service: filters in requests, a stream by update time, and a target that tasks stage and the driver commits."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from siltstone.sources.paged import clause, register

T0 = "2024-01-01T00:00:"


@pytest.fixture
def service(spark):
    """A service with rows (id, name, at), which understands the filters that are asked for here, and a staging area."""
    rows = [{"id": i, "name": f"n{i % 3}", "at": f"{T0}{i:02}"} for i in range(40)]
    asked, staged, committed, ended = [], {}, [], set()

    def holds(row, where):
        for part in where.split(" AND "):
            if m := re.fullmatch(r"(\w+) (=|>|>=|<|<=) '(.*)'", part):
                a, b = str(row[m[1]]), m[3]
                if not {"=": a == b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[m[2]]:
                    return False
            elif not re.fullmatch(r"\w+ is not null", part):
                raise ValueError(part)
        return True

    class Handler(BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            asked.append(q)
            found = [r for r in rows if holds(r, q["$where"])] if "$where" in q else rows
            if q.get("$select", "").startswith("max"):
                return self.answer([{"newest": max((r["at"] for r in found), default=None)}])
            if q.get("$select", "").startswith("count"):
                return self.answer([{"n": str(len(found))}])
            low = int(q["$offset"])
            self.answer(found[low : low + int(q["$limit"])])

        def do_POST(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if q["run"] in ended:  # what tasks still send after the end of a run is not kept
                pass
            elif q["action"] == "stage":
                staged.setdefault(q["run"], {}).setdefault(q["part"], []).extend(body)
            elif q["action"] == "commit":
                committed.extend(r for part in body for r in staged[q["run"]].get(part, []))
                staged.pop(q["run"], None)
            else:
                staged.pop(q["run"], None)
            if q["action"] != "stage":
                ended.add(q["run"])
            self.answer({})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    register(spark)
    yield f"http://127.0.0.1:{server.server_port}/rows.json", rows, asked, staged, committed
    server.shutdown()


def test_filters_arrive_in_the_request(spark, service):
    url, _, asked, _, _ = service
    rows = spark.read.format("paged_json").schema("id string, name string, at string").option("url", url).option("maxRecords", 100).option("pageSize", 7).option("rangeRecords", 20).option("ordered", "at").load()
    got = rows.filter((F.col("name") == "n1") & (F.col("at") >= f"{T0}10") & (F.col("id") > "2") & (F.length("id") == 2)).collect()
    assert sorted(int(r.id) for r in got) == [i for i in range(20, 40) if i % 3 == 1]
    pages = [q for q in asked if "$offset" in q]
    assert pages and all("name = 'n1'" in q["$where"] and f"at >= '{T0}10'" in q["$where"] and "id >" not in q["$where"] for q in pages)


def test_clauses():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, Not, StringStartsWith

    assert clause(EqualTo(("a",), "it's"), ()) == "a = 'it''s'" and clause(In(("a",), (1, "x")), ()) == "a in (1, 'x')"
    assert clause(GreaterThan(("a",), "x"), ()) is None and clause(GreaterThan(("a",), "x"), ("a",)) == "a > 'x'"
    assert clause(StringStartsWith(("a",), "x"), ()) == "starts_with(a, 'x')" and clause(IsNull(("a",)), ()) == "a is null" and clause(Not(EqualTo(("a",), 1)), ()) is None


def test_stream_goes_on_at_its_offset(spark, service, tmp_path):
    url, rows, asked, _, _ = service

    def run():
        stream = spark.readStream.format("paged_json").schema("id string, at string").option("url", url).option("cursor", "at").option("since", f"{T0}29").option("pageSize", 4).option("rangeRecords", 6).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(once=True).start().awaitTermination()
        return sorted(int(r.id) for r in spark.read.schema("id string, at string").parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(30, 40))
    rows += [{"id": i, "name": "late", "at": f"{T0}{i:02}"} for i in range(40, 53)]
    rows[3]["at"] = f"{T0}55"  # updated since
    asked.clear()
    assert run() == sorted([*range(30, 53), 3])
    assert all(f"at > '{T0}39'" in q["$where"] for q in asked if "$offset" in q) and any("$offset" in q for q in asked)


def test_tasks_stage_and_the_driver_commits(spark, service):
    url, _, _, staged, committed = service
    rows = spark.range(25).select("id", F.concat(F.lit("r"), "id").alias("name")).repartition(3)
    rows.write.format("paged_json").option("url", url).option("pageSize", 4).mode("append").save()
    assert sorted(r["id"] for r in committed) == list(range(25)) and all(r["name"] == f"r{r['id']}" for r in committed) and not staged
    committed.clear()

    @F.udf("long")
    def breaks(i):
        if i == 24:
            raise ValueError("no such row")
        return i

    with pytest.raises(Exception, match="no such row|aborted|WRITING_JOB"):
        rows.withColumn("id", breaks("id")).write.format("paged_json").option("url", url).option("pageSize", 2).mode("append").save()
    assert committed == [] and not staged
