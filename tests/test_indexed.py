"""Skipping indexes, event time, streams with state, table functions and the incremental catalogue."""

import http.server
import json
import random
import threading
import time
import urllib.parse
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodeseam import queries_indexed as Q
from lodeseam import schemas
from lodeseam.config import Config, Profile
from lodeseam.functions import chunking, tables
from lodeseam.functions.embedding import hashed
from lodeseam.functions.frontmatter import parse_frontmatter
from lodeseam.operators import block_max, catalog, ingest, pivots, temporal
from lodeseam.operators import retrieval as R
from lodeseam.plans.engine import Engine
from lodeseam.sources import testcases
from lodeseam.streaming import changes

SF = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else (T0 + timedelta(seconds=seconds)).replace(tzinfo=None)


# ---------------------------------------------------------------- block bounds


def test_block_max_skips_blocks_and_loses_nothing(spark):
    blocks, stats, frequencies = Q.keyword_blocks(spark, SF)
    docs = Q._table(spark, SF, "documents")
    for terms, n in ((["ering", "the"], 5), (["the"], 10), (["blended", "water", "the"], 25), (["qqxzzy"], 5), ([], 5), (["the"], 0)):
        got = [(r.doc_id, round(r.score, 9)) for r in block_max.block_max_top(blocks, stats, frequencies, ["doc_id"], terms, n, seed=2).collect()]
        every = R.bm25(docs, ["doc_id"], "text", " ".join(terms)) if terms else None
        want = [(r.doc_id, round(r.score, 9)) for r in R.top(every, ["doc_id"], n).collect()] if terms and n else []
        assert got == want, terms
    mine = blocks.where("token = 'the'")
    read = block_max.reaching(blocks, stats, frequencies, ["doc_id"], ["the"], 10, seed=2)
    assert 0 < read.count() < 0.7 * mine.count()
    bound = {r.range: r.bound for r in block_max.bounds(blocks, stats, frequencies, ["the"]).collect()}
    exact = mine.select("range", F.explode("postings").alias("p")).select("range", "p.doc_id").join(block_max.scores(mine, stats, frequencies, ["doc_id"], ["the"]), "doc_id").groupBy("range").agg(F.max("score").alias("m"))
    assert all(r.m <= bound[r.range] * (1 + 1e-9) for r in exact.collect())


# ---------------------------------------------------------------- pivots


def test_pivots_read_few_rows_and_lose_none(spark):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(i, [c + draw.gauss(0, 0.05) for c in centres[i % 20]]) for i in range(2000)] + [(2000, None), (2001, rows0 := [0.0] * 8), (2002, rows0)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    chosen = pivots.choose(df, ["id"], "v", 24)
    table = pivots.pivot_table(df, ["id"], "v", chosen)
    assert table.count() == 2002
    for query, k in ((rows[5][1], 10), ([0.1] * 8, 3), (rows[7][1], 5000)):
        got = [r.id for r in pivots.nearest(table, ["id"], "v", chosen, query, k).collect()]
        want = [r.id for r in df.where("v IS NOT NULL").select("id", R.distance(F.col("v"), query).alias("d")).orderBy("d", "id").limit(k).collect()]
        assert got == want
    assert table.where(pivots.reach(table, ["id"], "v", chosen, rows[5][1], 10)).count() < 300
    assert pivots.nearest(pivots.pivot_table(df.limit(0), ["id"], "v", []), ["id"], "v", [], [0.0] * 8, 3).count() == 0


# ---------------------------------------------------------------- event time


@pytest.mark.parametrize("piece", [1 << 20, 5])
def test_asof_join_of_hot_and_odd_keys(spark, piece):
    draw = random.Random(piece)
    key = lambda: draw.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), at(draw.choice([None, *range(0, 60, 3)]))) for i in range(80)]
    right = [(key(), at(draw.choice([None, *range(0, 60, 3)])), i % 7, f"r{i}") for i in range(50)]
    a = spark.createDataFrame(left, "id int, k string, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    b = spark.createDataFrame(right, "k string, t timestamp_ntz, o int, name string").withColumn("t", F.col("t").cast("timestamp"))
    joined = temporal.asof_join(a, b, ["k"], "t", ["o", "name"], [], piece)
    got = {r.id: r["asof"] and r["asof"].name for r in joined.collect()}
    want = {}
    for i, k, t in left:
        known = [(rt, o, n) for rk, rt, o, n in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        want[i] = max(known)[2] if known else None
    assert got == want and joined.columns == ["id", "k", "t", "asof"]
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_interval_join_of_hot_and_odd_keys(spark, most):
    draw = random.Random(most)
    key = lambda: draw.choice(["hot", "hot", "a", None])
    points = [(i, key(), at(draw.choice([None, *range(100)]))) for i in range(70)]
    spans = [(i, key(), at(s := draw.choice([None, *range(100)])), at(None if s is None else s + draw.choice([-1, 0, 1, 2, 9, 70]))) for i in range(60)]
    p = spark.createDataFrame(points, "id int, k string, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    s = spark.createDataFrame(spans, "span int, k string, lo timestamp_ntz, hi timestamp_ntz").withColumn("lo", F.col("lo").cast("timestamp")).withColumn("hi", F.col("hi").cast("timestamp"))
    joined = temporal.interval_join(p, s, ["k"], "t", "lo", "hi", most)
    got = sorted((r.id, r.span) for r in joined.collect())
    want = sorted((i, j) for i, k, t in points for j, sk, lo, hi in spans if k is not None and k == sk and t is not None and lo is not None and lo <= t < hi)
    assert got == want and len(want) > 50
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert temporal.interval_join(p, s.limit(0), ["k"], "t", "lo", "hi", most).count() == 0


def _landed(spark, folder, schema, batches):
    """A stream that gets one batch after another; each call of ``feed`` lands the next."""
    folder.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    for i, rows in enumerate(batches):
        file = folder / f"{i:03d}.json"
        file.write_text("".join(json.dumps(r, default=lambda t: t.isoformat() + "Z") + "\n" for r in rows))
        stamp = time.time() - 1000 + i
        import os

        os.utime(file, (stamp, stamp))
    return stream


def test_streamed_sessions_are_those_of_the_batch(spark, tmp_path):
    row = lambda u, s: {"user_id": u, "ts": at(s)}
    batches = [[row(1, 0), row(1, 100), row(2, 50)], [row(1, 30), row(1, 500)], [row(2, 5000)], [row(2, 5001)], [row(1, 20)], [row(9, 100000)], [row(9, 200000)]]
    stream = _landed(spark, tmp_path / "in", "user_id long, ts timestamp", batches)
    found = temporal.sessions(stream, ["user_id"], "ts", "2 minutes", late="10 minutes", n=F.count("*"))
    query = found.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    got = {(r.user_id, int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in spark.table("sessions_out").collect()}
    kept = [r for b in batches[:4] for r in b] + batches[5]  # the row at 20 s came when the watermark was past it
    batch = temporal.sessions(spark.createDataFrame([(r["user_id"], r["ts"].replace(tzinfo=timezone.utc)) for r in kept], "user_id long, ts timestamp"), ["user_id"], "ts", "2 minutes", n=F.count("*"))
    want = {(r.user_id, int(r.start.timestamp()), int(r.end.timestamp()), r.n) for r in batch.collect()}
    assert got == want and (1, int(T0.timestamp()), int(T0.timestamp()) + 220, 3) in got


# ---------------------------------------------------------------- change detection with state


def test_changes_are_those_of_the_batch_merge(spark, tmp_path):
    row = lambda d, seq, text, deleted=False, s=0: {"doc_id": d, "seq": seq, "at": at(s or seq), "deleted": deleted, "text": text}
    batches = [
        [row("a", 1, "one"), row("b", 2, "x"), row("a", 3, "two")], [row("a", 2, "late"), row("b", 2, "x"), row("c", 5, "c", True)],
        [row("b", 7, "gone", True), row("a", 4, "two")], [row("b", 6, "reordered"), row("c", 4, "before"), row("d", 9, "d")], [row("a", 10, "three"), row("a", 9, "no"), row(None, 1, "n")],
    ]
    schema = "doc_id string, seq long, at timestamp, deleted boolean, text string"
    stream = changes.detect_changes(_landed(spark, tmp_path / "in", schema, batches), late="1 hour")
    query = stream.writeStream.format("parquet").outputMode("append") if False else stream.writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out")))
    query = query.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    out = [r for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()]
    last = {r.doc_id: (r.text, r.deleted) for r in out}
    flat = [r for b in batches for r in b if r["doc_id"]]
    stored = spark.createDataFrame([], "doc_id string, text string, deleted boolean, created_at string, updated_at string")
    merged = ingest.merge(stored, spark.createDataFrame([(r["doc_id"], r["text"], r["deleted"], r["seq"]) for r in flat], "doc_id string, text string, deleted boolean, seq long"), F.lit("t"))
    assert last == {r.doc_id: (r.text, r.deleted) for r in merged.collect()}
    assert [(r.doc_id, r.change, r.text) for r in out if r.doc_id == "a"] == [("a", "new", "two"), ("a", "changed", "three")]
    assert [(r.change, r.text) for r in out if r.doc_id == "b"] == [("new", "x"), ("tombstone", "gone")] and [r.change for r in out if r.doc_id == "c"] == ["tombstone"]


def test_tombstones_are_forgotten_by_a_timer(spark, tmp_path):
    row = lambda d, seq, deleted, s: {"doc_id": d, "seq": seq, "at": at(s), "deleted": deleted, "text": "t"}
    batches = [[row("a", 5, True, 0), row("b", 1, False, 0)], [row("x", 1, False, 100000)], [row("x", 2, False, 200000)], [row("x", 3, False, 300000)], [row("a", 1, False, 300000)]]
    stream = changes.detect_changes(_landed(spark, tmp_path / "in", "doc_id string, seq long, at timestamp, deleted boolean, text string", batches), late="1 minute", keep="10 minutes")
    query = stream.writeStream.format("memory").queryName("forgotten").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    # the smaller number of a document whose tombstone was forgotten is a new document
    assert sorted((r.doc_id, r.change, r.seq) for r in spark.table("forgotten").where("doc_id <> 'x'").collect()) == [("a", "new", 1), ("a", "tombstone", 5), ("b", "new", 1)]


# ---------------------------------------------------------------- the service as a stream


@pytest.fixture
def listing():
    cases, asked, counted = [], [], [True]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            options = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)
            first, most = int(options.get("startAt", ["0"])[0]), int(options.get("maxResults", ["50"])[0])
            page = cases[first : first + most]
            reply = {"values": page, "isLast": first + most >= len(cases)} | ({"total": len(cases)} if counted[0] else {})
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", cases, asked, counted
    server.shutdown()


def test_a_stream_of_cases_resumes_where_it_was(spark, tmp_path, listing):
    base, cases, asked, counted = listing
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run(more, count):
        cases.extend([{"id": i, "key": f"K-{i}", "name": "n"} for i in range(len(cases), len(cases) + more)])
        counted[0] = count
        query = testcases.stream_cases(spark, base, "", ["K"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        return sorted((r.at, r.key) for r in spark.read.parquet(out).select("at", "key").collect())

    everything = lambda: [(i, f"K-{i}") for i in range(len(cases))]
    assert run(120, True) == everything()
    assert sum("maxResults=50" in a or "maxResults=20" in a for a in asked) >= 3  # page by page
    asked.clear()
    assert run(7, False) == everything()
    assert not any("startAt=0&maxResults=20" in a for a in asked)
    assert run(0, True) == everything()


def test_filters_reach_the_service(spark, listing):
    base, cases, asked, _ = listing
    cases.append({"key": "K-1"})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = testcases.read_pages(spark, base, "", ["one", "two", "three"]).where("path = 'two'").collect()
        assert [r.path for r in rows] == ["two"] and {a.split("?")[0] for a in asked} == {"/two"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


# ---------------------------------------------------------------- table functions


def test_table_functions_equal_the_columns(spark):
    tables.register(spark)
    docs = Q._table(spark, SF, "documents").where("doc_id < 150").select("doc_id", "text", "lang")
    docs.unionByName(spark.createDataFrame([(900, None, None), (901, "", "x")], docs.schema)).createOrReplaceTempView("some_docs")
    for part in ("", " PARTITION BY (lang)"):
        got = spark.sql(f"SELECT doc_id, chunk_ix, start, end, chunk_text FROM chunks(TABLE(some_docs){part}, 'text', 900, 100)")
        want = chunking.chunk_documents(spark.table("some_docs"), "text", 900, 100).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    notes = spark.createDataFrame([(1, "---\ntags: ['#b', a]\nx: 1\n---\nbody\n"), (2, "plain"), (3, None), (4, "---\n: : bad\n\t-\n---\nrest"), (5, "---\r\na: 1\r\n---\r\nz"), (6, "---\na: 1\n---")], "id int, note string")
    notes.createOrReplaceTempView("some_notes")
    got = spark.sql("SELECT id, body, tags, frontmatter_json FROM frontmatter(TABLE(some_notes) PARTITION BY (id), 'note')")
    assert sorted(map(str, got.collect())) == sorted(map(str, parse_frontmatter(notes, "note").select(*got.columns).collect()))
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM chunks(TABLE(some_notes), 'nothing')").collect()


# ---------------------------------------------------------------- the incremental catalogue


def test_the_catalogue_follows_writes(spark, tmp_path):
    engine = Engine(spark, Config(home=str(tmp_path / "home"), profiles=[Profile("p", model="m")], buckets=4), embedder=lambda p: hashed(8))
    row = lambda i, tags, deleted=False, text="t": (1, ("s", f"c{i % 3}", str(i), None), (f"d{i}", f"title {i}", f"{text} {i}", "sha256:" + f"{i:064x}", "2024-01-01T00:00:00Z", deleted), ("note", "public" if i % 2 else "internal", tags, None, None, None))
    write = lambda rows: engine.ingest(spark.createDataFrame(rows, schemas.ENVELOPE).withColumn("seq", F.lit(0)))

    def in_step():
        for c in (None, "public"):
            assert engine.topics(c) == [r.asDict() for r in catalog.browse_topics(engine.documents(), c).collect()]
        live = engine.documents().where("NOT deleted")
        full = live.agg(F.countDistinct("content_hash").alias("contents"), F.countDistinct("connector_instance").alias("sources"), F.countDistinct("title").alias("titles")).first().asDict()
        got = engine.distinct()
        assert all(abs(got.get(k, 0) - n) <= 0.03 * n + 0.5 for k, n in full.items()), (got, full)

    write([row(i, ["a", f"t{i % 4}", " a "]) for i in range(300)])
    in_step()
    before = engine.store.parts("sketches")
    write([row(7, ["b"]), row(8, None, True), row(1000, ["a", "new"])])
    in_step()
    touched = set(engine.store.touched("documents", spark.createDataFrame([("d7",), ("d8",), ("d1000",)], "doc_id string")))
    assert sum(before[b] != p for b, p in engine.store.parts("sketches").items()) <= len(touched)
    engine.store.compact("topics", schemas.TOPICS)
    engine.store.compact("sketches", schemas.SKETCHES)
    in_step()
    write([row(i, ["z"], True) for i in range(300)] + [row(1000, [], True)])
    assert engine.topics() == []
