import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from lodestack.config import load_settings, read_env_file
from lodestack.operators import admin, crawl, encoders, feedback
from lodestack.operators.upsert import create_table, latest_by, read_table, upsert, upsert_table
from lodestack.plans import pipeline
from lodestack.sources import ndjson, wiki_rest
from lodestack.streaming import feeds


def entries(spark, *rows):
    return spark.createDataFrame([("q", "a", t, [("T", "u")], "2024-01-0%d" % (i + 1), f"f{i}") for i, t in enumerate(rows)], "question string, answer string, feedback string, sources array<struct<title:string,url:string>>, day string, feedback_id string")


def test_feedback_store(spark, tmp_path):
    path = str(tmp_path / "feedback")
    stored = feedback.save_feedback(entries(spark, "positive", "positive", "negative"), path)
    feedback.save_feedback(entries(spark, "positive"), path)
    got = spark.read.parquet(path)
    assert got.count() == 4 and got.select("feedback_id").distinct().count() == 4 and got.where("created_at IS NULL").count() == 0
    assert {r.feedback_id for r in stored.collect()} <= {r.feedback_id for r in got.collect()}
    assert tuples(feedback.feedback_stats_total(got)) == [("negative", 1), ("positive", 3), ("total", 4)]
    assert tuples(feedback.feedback_stats_total(got.where("false"))) == [("total", 0)]


def test_recent_feedback(spark):
    f = entries(spark, "positive", "negative", "positive").withColumn("created_at", F.to_timestamp("day")).withColumnRenamed("feedback", "feedback_type")
    ids = lambda df: [r.feedback_id for r in df.collect()]
    assert ids(feedback.recent_feedback(f, 2)) == ["f2", "f1"]
    assert ids(feedback.recent_feedback(f, 0)) == ids(feedback.recent_feedback(f, 0, "")) == ["f2", "f1", "f0"]
    assert ids(feedback.negative_feedback_for_review(f)) == ["f1"]


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("7", 1, "x"), ("8", 1, "y")], "k string, v int, keep string")
    new = spark.createDataFrame([("7", 2)], "k string, v int")
    assert tuples(upsert(old, new, ["k"])) == [("7", 2, "x"), ("8", 1, "y")]
    path = str(tmp_path / "t")
    upsert_table(old, path, ["k"])
    upsert_table(spark.createDataFrame([("9", 3, "z"), ("7", 5, "w")], "k string, v int, keep string"), path, ["k"])
    assert tuples(read_table(spark, path)) == [("7", 5, "w"), ("8", 1, "y"), ("9", 3, "z")]
    assert tuples(latest_by(old.unionByName(old.withColumn("v", F.lit(9))), ["k"], F.col("v")), "k", "v") == [("7", 9), ("8", 9)]


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    upsert_table(spark.range(200).selectExpr("cast(id AS string) AS k", "id AS v"), path, ["k"], buckets=16)
    before = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")}
    upsert_table(spark.createDataFrame([("7", 70)], "k string, v long"), path, ["k"])
    after = {p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")}
    assert len(after - before) == 1 and read_table(spark, path).count() == 200 and read_table(spark, path).where("k = '7'").first().v == 70
    (tmp_path / "t" / "part-9-torn").mkdir()  # what a crash before the commit leaves is not read
    assert read_table(spark, path).count() == 200


def test_older_rows_of_later_batches_lose(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    one = lambda at, v, no: spark.createDataFrame([("a", at, v)], "k string, at int, v string").coalesce(1).write.parquet(str(src / f"{no}"))
    one(20, "new", 0)
    for no, (at, v, want) in enumerate([(None, None, "new"), (10, "old", "new"), (20, "again", "again"), (30, "newest", "newest")], 1):
        if at:
            one(at, v, no)
        stream = spark.readStream.schema("k string, at int, v string").option("recursiveFileLookup", "true").parquet(str(src))
        feeds.upsert_stream(stream, out, ["k"], "at", str(tmp_path / "cp")).awaitTermination()
        assert [r.v for r in read_table(spark, out).collect()] == [want]


def test_chunks_of_emptied_pages_go(spark, tmp_path):
    path = str(tmp_path / "points")
    schema = "page_id string, version int, title string, url string, content_text string, internal_links array<string>, synced_at string"
    ingest = lambda *rows: pipeline.ingest(spark.createDataFrame([(p, v, "T", "u", t, None, "x") for p, v, t in rows], schema), path)
    assert ingest(("1", 1, "hello world text"), ("2", 1, "other")).count() == 2
    assert [r.page_id for r in ingest(("1", 2, "")).collect()] == ["2"]
    assert {r.chunk for r in ingest(("1", 3, "back"), ("2", 2, None)).collect()} == {"back"}


def test_registered_encoders_reach_the_workers(spark):
    encoders.register("shout", lambda: lambda texts: [[1.0, float(len(t or ""))] for t in texts])
    got = encoders.encode(spark.createDataFrame([("abc",), (None,)], "t string").repartition(2), "t", dense="shout")
    assert sorted(r.dense[1] for r in got.collect()) == [0.0, 3.0]
    with pytest.raises(KeyError):
        encoders.encode(spark.createDataFrame([("abc",)], "t string"), "t", dense="nobody")


def test_stored_feedback_is_partitioned(spark, tmp_path):
    path = str(tmp_path / "f")
    feedback.save_feedback(entries(spark, "positive", "negative", None), path)
    got = feedback.read_feedback(spark, path, "negative", "2000-01-01")
    assert [r.feedback_type for r in got.collect()] == ["negative"] and "day" not in got.columns
    assert "PartitionFilters: [isnotnull(by_type" in got._jdf.queryExecution().executedPlan().toString()
    assert feedback.read_feedback(spark, path).count() == 3


def test_create_table_checks_the_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    assert create_table(spark, path, "a int").count() == create_table(spark, path, "a int").count() == 0
    with pytest.raises(ValueError):
        create_table(spark, path, "a string")


EDGES = [("1", "2"), ("1", "3"), ("2", "4"), ("3", "4"), ("4", "1"), ("5", "1")]


def test_crawl_closure(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string")
    assert tuples(crawl.bfs(e, "1")) == [("1", 0), ("2", 1), ("3", 1), ("4", 2)]
    assert tuples(crawl.bfs(e, "1", max_pages=2), "page_id") == [("1",), ("2",)]
    failed = spark.createDataFrame([("2",), ("3",)], "page_id string")
    assert tuples(crawl.bfs(e, "1", failed=failed), "page_id") == [("1",), ("2",), ("3",)]
    odd = spark.createDataFrame([("1", None), ("1", "2"), ("1", "2")], "src string, dst string")
    assert tuples(crawl.edges_of(odd, odd)) == [("1", "2")]


class Wiki(BaseHTTPRequestHandler):
    fails: dict = {}

    def do_GET(self):
        path = self.path
        left = self.fails.get(path, 0)
        if left:
            self.fails[path] = left - 1
            self.send_error(503)
            return
        if "/space/" in path:
            got = {"homepage": {"id": 1}}
        elif "/child/page" in path:
            pid = path.split("/content/")[1].split("/")[0]
            kids = [d for s, d in EDGES if s == pid]
            if "start=1" in path:
                got = {"results": [{"id": k} for k in kids[1:]], "_links": {}}
            else:
                got = {"results": [{"id": k} for k in kids[:1]], "_links": {"next": path + "&start=1"} if len(kids) > 1 else {}}
        else:
            pid = path.split("/content/")[1].split("?")[0]
            if pid == "3":
                self.send_error(404)
                return
            got = {"title": f"P {pid}", "version": {"number": 2, "when": "2024"}, "body": {"storage": {"value": "<p>x</p><a href='/pages/6'>y</a>" if pid == "2" else "<p>x</p>"}}}
            if pid == "6":
                del got["title"], got["version"], got["body"]
        body = json.dumps(got).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def wiki():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_rest_source(spark, wiki):
    Wiki.fails = {"/rest/api/space/S?expand=homepage": 2}
    waits = []
    assert wiki_rest.home_page_id(wiki, "S", sleep=waits.append) == "1" and waits == [1.5, 3.0]
    Wiki.fails = {"/rest/api/space/S?expand=homepage": 9}
    with pytest.raises(RuntimeError):
        wiki_rest.home_page_id(wiki, "S", sleep=waits.append)
    Wiki.fails = {}
    assert list(wiki_rest.child_ids(wiki, "1")) == ["2", "3"]
    pages, attempted = wiki_rest.crawl(spark, wiki, "S", backoff="0.1")
    assert attempted == ["1", "2", "3", "4", "6"]  # 3 fails and contributes nothing; 6 is linked from a page's text
    got = {r.page_id: r for r in pages.collect()}
    assert set(got) == {"1", "2", "4", "6"} and got["2"].url == f"{wiki}/spaces/S/pages/2/P+2" and got["6"].title == "Untitled-6" and got["6"].version == 1 and got["6"].content_html == ""
    stats = {}
    assert wiki_rest.crawl(spark, wiki, "S", max_pages=2, stats=stats, backoff="0.1")[1] == ["1", "2"]
    assert stats["pages"] == stats["attempted"] == 2 and stats["seconds"] > 0


def test_ndjson(spark, tmp_path):
    events = spark.createDataFrame([("q", 0, '{"type":"end"}'), ("r", 0, "x")], "query_id string, seq int, event string")
    path = str(tmp_path / "ev")
    ndjson.write_events(events, path)
    (tmp_path / "ev" / "bad.txt").write_text("not json\n")
    assert tuples(ndjson.read_events(spark, path)) == [("q", 0, '{"type":"end"}'), ("r", 0, "x")]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("a", 1, "2024-01-01 00:10:00"), ("a", 2, "2024-01-01 00:20:00"), ("b", 1, "2024-01-01 01:10:00")]
    spark.createDataFrame(rows, "k string, v int, t string").withColumn("t", F.to_timestamp("t")).repartition(2).write.parquet(src)
    counts = feeds.run_to_table(feeds.windowed_counts(feeds.stream_of(spark, src), "t", "k"))
    assert sorted(r.n for r in counts.collect()) == [1, 2]
    once = feeds.run_to_table(feeds.deduplicated(feeds.stream_of(spark, src), "k", "t").select("k"), "append")
    assert tuples(once) == [("a",), ("b",)]
    for _ in range(2):  # a second run finds nothing new and leaves the table as it is
        feeds.upsert_stream(feeds.stream_of(spark, src, 1), out, ["k"], "v", str(tmp_path / "cp")).awaitTermination()
        assert {r[0] for r in tuples(read_table(spark, out), "k")} == {"a", "b"}


def test_admin(spark):
    v = spark.createDataFrame([("b", [1.0]), ("a", [1.0, 2.0]), ("a", None)], "id string, dense array<double>")
    assert tuple(admin.collection_stats(v, "id", "dense").first()) == (3, 2, 2, 1, 2)
    assert admin.sample_payload(v, "id").first().asDict() == {"id": "a"}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nLODESTACK_TOP_K=3\nLODESTACK_WIKI_BASE='https://a//'\n")
    (tmp_path / ".env.local").write_text("export LODESTACK_TOP_K=4\n")
    got = load_settings(tmp_path)
    assert got.top_k == 4 and got.wiki_base == "https://a" and got.child_size == 400
    monkeypatch.setenv("LODESTACK_TOP_K", "9")
    assert load_settings(tmp_path).top_k == 9 and read_env_file(tmp_path / "none") == {}
