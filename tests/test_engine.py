import http.server
import io
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodeseam import schemas
from lodeseam.__main__ import main
from lodeseam.config import Config, ConfigError, Profile, expand, key_value
from lodeseam.functions.embedding import hashed
from lodeseam.operators import folders, ingest
from lodeseam.operators import retrieval as R
from lodeseam.plans import engine as E
from lodeseam.plans import store as S
from lodeseam.plans.engine import Engine, SearchError
from lodeseam.plans.store import LostPointer
from lodeseam.serve.jsonrpc import Server
from lodeseam.sources import filesystem, testcases
from lodeseam.streaming import ingest as stream


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    (root / "one_note.md").write_text("---\ntags: ['#river', lake]\narea: north\n---\nThe river runs past the quiet mill.\n")
    (root / "sub" / "two.md").write_text("Boats on the lake carry timber to the mill.\n")
    (root / "three.txt").write_text("Nothing about water here, only stones.\n")
    (root / "bad.md").write_bytes(b"\xff\xfe\x00broken")
    (root / "skip.csv").write_text("a,b")
    return root


@pytest.fixture
def engine(spark, tmp_path, library):
    config = Config(home=str(tmp_path / "home"), profiles=[Profile("p1", model="m"), Profile("p2", model="m")], routing={"public": "p2"}, threshold=0.0, buckets=4, connectors=[{"id": "files", "type": "filesystem", "root": str(library), "exclude": ["*.csv"]}])
    return Engine(spark, config, embedder=lambda p: hashed(16))


def test_discovery_and_globs(spark, library):
    found = lambda **k: sorted(r.rel_path for r in filesystem.discover(spark, str(library), (".md", ".TXT"), **k).select("rel_path").collect())
    assert found() == ["bad.md", "one_note.md", "sub/two.md", "three.txt"]
    assert found(exclude=["sub/**"]) == ["bad.md", "one_note.md", "three.txt"]
    assert found(exclude=["sub", "[", "b?d.md", "{one,three}*"]) == []
    rows = {r.source.external_id: r for r in filesystem.envelopes(spark, str(library)).collect()}
    assert set(rows) == {"one_note.md", "sub/two.md", "three.txt"}
    one = rows["one_note.md"]
    assert one.document.title == "one note" and one.metadata.tags == ["lake", "river"] and json.loads(one.metadata.frontmatter_json)["area"] == "north"
    assert one.document.markdown == "The river runs past the quiet mill.\n" and len(one.document.content_hash) == 71
    assert one.document.doc_id.split(":")[0] == "filesystem" and len(one.document.doc_id.split(":")[1]) == 12
    assert filesystem.envelopes(spark, str(library)).select(ingest.validation_error("filesystem").alias("e")).where("e IS NOT NULL").count() == 0


def test_sync_index_search(spark, engine, library):
    with pytest.raises(SearchError):
        engine.search("mill")
    report = engine.sync()
    assert report["succeeded"] == 1 and report["ingest"]["files"]["written"] == 3 and report["index"]["indexed"] == 3
    assert {r.status for r in engine.readiness().where("profile_id = 'p1'").collect()} == {"ready"}
    hits = engine.search("mill", mode="keyword", group_by_doc=True)
    assert [h["title"] for h in hits] == ["one note", "two"] or [h["title"] for h in hits] == ["two", "one note"]
    assert all(h["chunk_count"] == 1 for h in hits)
    only = engine.search("mill", R.SearchFilter(frontmatter={"area": "north"}), mode="hybrid", group_by_doc=True)
    assert [h["title"] for h in only] == ["one note"] and only[0]["frontmatter"]["area"] == "north"
    assert engine.search("boats lake timber", mode="semantic", limit=1)[0]["title"] == "two"
    assert len(engine.search("mill", limit=0)) == 1 and engine.search("mill", limit=0, group_by_doc=True) == []
    assert {t["tag"] for t in engine.topics()} == {"lake", "river"}
    # nothing changed: nothing is written again
    again = engine.sync()
    assert again["ingest"]["files"] == {"processed": 3, "written": 0, "unchanged": 3, "tombstoned": 0, "deleted_files": 0, "duplicate_doc_ids": 0} and again["index"]["indexed"] == 0
    (library / "three.txt").write_text("Now a waterfall by the mill.\n")
    third = engine.sync()
    assert third["ingest"]["files"]["written"] == 1 and third["index"]["indexed"] == 1
    assert len(engine.search("mill", mode="keyword", group_by_doc=True)) == 3
    gone = engine.documents().where("external_id = 'three.txt'").first()
    tomb = spark.createDataFrame([(1, (gone.plugin_id, gone.connector_instance, gone.external_id, None), (gone.doc_id, "t", "", gone.content_hash, "2024-01-01T00:00:00Z", True), ("note", "internal", None, None, None, None))], schemas.ENVELOPE).withColumn("seq", F.lit(1))
    assert engine.ingest(tomb)["tombstoned"] == 1 and engine.ingest(tomb, dry_run=True)["deleted_files"] == 0
    assert engine.index()["deleted"] == 1
    assert len(engine.search("mill", mode="keyword", group_by_doc=True)) == 2


def test_failures_are_isolated(spark, engine):
    engine.sync()
    real = engine.embedder
    engine.embedder = lambda p: (_ for _ in ()).throw(ConnectionError("down"))
    assert engine.search("mill", mode="hybrid")  # falls back to keywords
    with pytest.raises(SearchError):
        engine.search("mill", mode="semantic")
    engine.embedder = real
    engine.config.connectors.append({"id": "broken", "type": "nothing"})
    report = engine.sync()
    assert report["failed"] == 1 and report["succeeded"] == 1 and report["index"] == "skipped_due_to_failures"
    assert engine.sync(["files"], dry_run=True)["index"] == "dry_run"
    with pytest.raises(ConfigError):
        engine.sync(["unknown"])


def test_served_tools_and_commands(engine, capsys):
    engine.sync()
    server = Server(engine)
    call = lambda tool, **a: server.handle({"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    assert json.loads(call("search_library", query="mill", mode="KEYWORD")["result"]["content"][0]["text"])["total_results"] == 2
    assert call("search_library", query="mill", mode="fuzzy")["error"]["code"] == -32602
    assert call("search_library", query="mill", path_includes="x")["error"]["code"] == -32602
    assert call("search_library", query="mill", since="yesterday")["error"]["code"] == -32602
    assert json.loads(call("browse_topics")["result"]["content"][0]["text"])["total_topics"] == 2
    assert server.handle({"id": 2, "method": "nope"})["error"]["code"] == -32601
    assert server.handle({"method": "notifications/cancelled"}) is None
    assert len(server.handle({"id": 3, "method": "tools/list"})["result"]["tools"]) == 4
    limit = server.handle({"id": 3, "method": "tools/list"})["result"]["tools"][0]["inputSchema"]["properties"]["limit"]
    assert (limit["default"], limit["minimum"], limit["maximum"]) == (25, 1, 50)
    text = lambda tool, **a: json.loads(call(tool, **a)["result"]["content"][0]["text"])
    assert text("search_books", query="mill", mode="keyword")["results"] == [] and text("search_library", query="mill", limit=1, group_by_doc=False)["total_results"] == 1
    [row] = text("search_library", query="mill", mode="keyword", path_excludes=["two"])["results"]
    assert row["title"] == "one note" and row["search_mode"] == "keyword"
    engine.ingest(filesystem.import_document(engine.spark, "a/The Mill.pdf", "A mill on the river."))
    engine.index()
    [book] = text("list_books")["books"]
    assert book["title"] == "The Mill" and book["chunks"] == 1 and book["file"].endswith(".md")
    assert [r["doc_type"] for r in text("search_books", query="mill", frontmatter={})["results"]] == ["book"]
    assert call("nothing")["result"]["isError"]
    out = io.StringIO()
    server.serve(["{bad", '{"id": 4, "method": "ping"}'], out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [-32700, None]
    assert main(["search", "mill", "--mode", "keyword", "--limit", "1"], engine) == 0
    assert len(json.loads(capsys.readouterr().out)) == 1
    assert main(["tour"], engine) == 0 and main(["tour", "concepts"], engine) == 0 and main(["tour", "none"], engine) == 1
    assert main(["serve", "--check"], engine) == 0 and main(["doctor"], engine) == 0 and main(["instructions"], engine) == 0


def test_serving_needs_a_ready_profile(engine):
    assert main(["serve"], engine) == 1 and main(["serve", "--check"], engine) == 1
    report = engine.doctor()
    assert not report["serve_ready"] and report["serving"]["queryable_profiles"] == 0 and len(report["serving"]["issues"]) == 2
    assert [c["status"] for c in report["connectors"]] == ["ok"] and report["up_to_date"]
    engine.config.connectors += [{"id": "x", "type": "filesystem", "root": "/no/where"}, {"id": "y", "type": "testcases"}, {"id": "z"}]
    assert [len(c["issues"]) for c in engine.doctor()["connectors"]] == [0, 1, 3, 1]


def test_every_update_is_kept(spark, engine, library):
    """All documents change, whatever the sign of their hashes and sequence numbers."""
    for i in range(40):
        (library / f"n{i}.md").write_text(f"text {i}\n")
    assert engine.sync(index=False)["ingest"]["files"]["written"] == 43
    for i in range(40):
        (library / f"n{i}.md").write_text(f"other text {i}\n")
    assert engine.sync(index=False)["ingest"]["files"]["written"] == 40
    texts = {r.external_id: r.markdown for r in engine.documents().collect()}
    assert all(texts[f"n{i}.md"] == f"other text {i}\n" for i in range(40)) and len(texts) == 43
    assert engine.sync(index=False)["ingest"]["files"]["written"] == 0


def test_merge_orders_signed_numbers(spark):
    columns = "doc_id string, markdown string, markdown_path string, created_at string, updated_at string"
    stored = spark.createDataFrame([(str(i), "old", f"p{i}", "t0", "t0") for i in range(40)] + [("kept", "old", None, "t0", "t0")], columns)
    batch = spark.createDataFrame([(str(i), f"new{k}", f"q{k}", s) for i in range(45) for k, s in enumerate((-5, -2, 3 if i % 2 else -1))], "doc_id string, markdown string, markdown_path string, seq long")
    got = {r.doc_id: r for r in ingest.merge(stored, batch, F.lit("t1")).collect()}
    assert len(got) == 46 and all(got[str(i)].markdown == "new2" for i in range(45))
    assert got["3"].markdown_path == "p3" and got["3"].created_at == "t0" and got["3"].updated_at == "t1"
    assert got["44"].markdown_path == "q0" and got["44"].created_at == "t1" and got["kept"].updated_at == "t0"


def test_a_broken_envelope_fails_the_batch(spark, engine):
    engine.sync(index=False)
    row = lambda i, h: (1, ("s", "s", "e", None), (i, "t", "x", h, "2024-01-01T00:00:00Z", False), ("note", "internal", None, None, None, None))
    bad = spark.createDataFrame([row("a", "sha256:" + "0" * 64), row("b", "none")], schemas.ENVELOPE).withColumn("seq", F.lit(0))
    with pytest.raises(ValueError, match="'b' breaks rule 'content_hash'"):
        engine.ingest(bad)
    assert engine.documents().count() == 3


def test_a_crash_while_writing_loses_nothing(engine, library, monkeypatch):
    engine.sync()
    before = engine.store.snapshot()
    monkeypatch.setattr(type(engine.store), "create_json", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    (library / "three.txt").write_text("changed\n")
    assert engine.sync()["failed"] == 1
    monkeypatch.undo()
    assert engine.store.snapshot() == before and engine.documents().count() == 3
    assert engine.sync()["ingest"]["files"]["written"] == 1 and engine.documents().count() == 3
    for file in (library.parent / "home" / "log").iterdir():
        file.unlink()
    with pytest.raises(LostPointer):
        engine.documents()


def test_one_change_writes_one_document(spark, engine, library):
    engine.sync()
    names = ["documents", "index_state", *(f"{kind}/{engine.generation}/p1" for kind in ("chunks", "postings"))]
    before = engine.store.snapshot()
    (library / "three.txt").write_text("Now a waterfall.\n")
    engine.sync()
    for n in names:
        old, new = engine.store.parts(n, before), engine.store.parts(n)
        changed = [b for b in new if old.get(b) != new[b]]
        assert len(changed) == 1 and new[changed[0]]["base"] == old.get(changed[0], {"base": None})["base"], n
        rows = spark.read.parquet(f"{engine.config.home}/{new[changed[0]]['deltas'][-1][1]}")
        assert {r.doc_id.rsplit(":", 1)[1] for r in rows.collect()} == {"three.txt"}, n
    whole = R.postings(engine._chunks("p1"), ["doc_id", "chunk_ix"], "text", engine.analyse)
    stored = lambda kind, schema: engine.store.table(f"{kind}/{engine.generation}/p1", schema)

    def in_step():
        df = stored("frequencies", E._FREQUENCIES).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        assert {tuple(r) for r in R.document_frequencies(whole).collect()} == {tuple(r) for r in df.collect()}
        assert tuple(stored("sizes", E._SIZES).agg(F.sum("n"), F.sum("tokens")).first()) == tuple(whole.groupBy("doc_id", "chunk_ix").agg(F.first("dl").alias("dl")).agg(F.count("*"), F.sum("dl")).first())
        assert {tuple(r) for r in engine._postings("p1").select(*whole.columns).collect()} == {tuple(r) for r in whole.collect()}

    in_step()
    for n in engine.store.snapshot()["tables"]:
        engine.store.compact(n)
    assert not any(p["deltas"] for t in engine.store.snapshot()["tables"].values() for p in t["parts"].values())
    in_step()


_KV = "doc_id string, v int"


@pytest.fixture
def keyed(spark, tmp_path, monkeypatch):
    rows = lambda values: spark.createDataFrame(values, _KV)
    monkeypatch.setitem(S.TABLES, "t", rows([]).schema)
    store = S.Store(spark, str(tmp_path / "store"), 4)
    store.write("t", rows([(str(i), i) for i in range(40)]))
    return store, rows, lambda: {r.doc_id: r.v for r in store.table("t").collect()}


def test_writers_of_other_buckets_both_survive(spark, keyed):
    store, rows, content = keyed
    home = {r.doc_id: r.b for r in rows([(str(i), i) for i in range(40)]).select("doc_id", store.bucket_of("t").alias("b")).collect()}
    here, there, beside = "0", next(k for k in home if home[k] != home["0"]), next(k for k in home if home[k] == home["0"] and k != "0")
    one, two, three = store.begin(), store.begin(), store.begin()
    one.upsert("t", rows([(here, 100)]))
    two.upsert("t", rows([(there, 200)]))
    three.upsert("t", rows([(beside, 300)]))
    assert two.commit() < one.commit()
    with pytest.raises(S.Conflict):
        three.commit()
    again = store.begin()
    again.upsert("t", rows([(beside, 300)]), rows([("7", 0), (beside, 0)]).select("doc_id"))
    again.commit()
    assert content() == {str(i): i for i in range(40) if i != 7} | {here: 100, there: 200, beside: 300}


def test_racing_writers_lose_no_document(spark, engine, tmp_path):
    row = lambda i: (1, ("s", "s", i, None), (i, "t", "x " + i, "sha256:" + "0" * 64, "2024-01-01T00:00:00Z", False), ("note", "internal", None, None, None, None))
    failed = []

    def writer(k):
        mine = E.Engine(spark, engine.config, engine.embedder)
        try:
            for j in range(3):
                mine.ingest(spark.createDataFrame([row(f"w{k}-{j}")], schemas.ENVELOPE).withColumn("seq", F.lit(0)))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=writer, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and {r.doc_id for r in engine.documents().collect()} == {f"w{k}-{j}" for k in range(3) for j in range(3)}
    assert engine.store.table("blobs").count() == 9


def test_deltas_are_compacted(keyed):
    store, rows, content = keyed
    for k in range(S.MOST_DELTAS + 3):
        write = store.begin()
        write.upsert("t", rows([("3", 1000 + k), (f"n{k}", k)]))
        write.commit()
    assert max(len(p["deltas"]) for p in store.parts("t").values()) <= S.MOST_DELTAS
    expected = {str(i): i for i in range(40)} | {f"n{k}": k for k in range(S.MOST_DELTAS + 3)} | {"3": 1000 + S.MOST_DELTAS + 2}
    assert content() == expected
    store.compact("t")
    assert content() == expected and not any(p["deltas"] for p in store.parts("t").values())


def test_sums_of_racing_writers_add_up(spark, keyed):
    store = keyed[0]
    sums = lambda values: spark.createDataFrame(values, "token string, df long")
    writes = [store.begin() for _ in range(3)]
    for k, w in enumerate(writes):
        w.add("sums", sums([("a", 1), ("a", 1), ("b", k - 1)]), ["token"], ["df"])
    for w in writes:
        w.commit()
    total = lambda: {r[0]: r[1] for r in store.table("sums", sums([]).schema).groupBy("token").agg(F.sum("df")).collect()}
    assert total() == {"a": 6, "b": 0}
    store.compact("sums")
    assert total() == {"a": 6}


def test_restore_after_retention(keyed, monkeypatch):
    store, rows, content = keyed
    before = content()
    name = store.backup("kept")
    with pytest.raises(ValueError, match="exists"):
        store.backup("kept")
    monkeypatch.setattr(S, "RETAIN_HOURS", 0)
    for k in range(3):
        store.write("t", rows([(str(k), -1)]))
    time.sleep(1.1)
    assert store.clean() and content() == {"2": -1}  # the two writes between are gone, what the backup names isn't
    number = store.restore(name)
    assert content() == before and store.snapshot()["number"] == number
    store.write("t", rows([("x", 1)]))
    assert store.drop_backup(name) and store.backups() == []
    time.sleep(1.1)
    store.write("t", rows([("y", 1)]))
    store.clean()
    with pytest.raises(ValueError, match="no backup"):
        store.restore(name)
    assert content() == {"y": 1}


def test_an_empty_vector_skips_the_profile(engine):
    engine.sync()
    engine.embedder = lambda p: lambda texts: [[]]
    with pytest.raises(SearchError, match="empty vector"):
        engine.search("mill", mode="hybrid")
    assert engine.search("mill", mode="keyword")


def test_migrations_are_backed_up(spark, engine, capsys):
    engine.sync(index=False)
    manifest = engine.store.read_json("manifest.json")
    engine.store.write_json("manifest.json", manifest | {"versions": {"index": 1, "canonical": 9}, "files": [], "indexed_at": "x"})
    engine.store.bootstrap(engine.generation)
    new = engine.store.read_json("manifest.json")
    assert "files" not in new and new["versions"]["canonical"] == 9 and new["versions"]["index"] == manifest["versions"]["index"] and new["migrations"][-1]["component"]
    [name] = engine.store.backups()
    assert set(engine.store.read_json(f"backups/{name}/snapshot.json")["tables"]) == {"documents", "blobs", "topics", "sketches"} and new["updated_at"]
    assert main(["backup", "mine"], engine) == 0 and main(["restore", "mine"], engine) == 0 and main(["compact"], engine) == 0 and main(["clean"], engine) == 0 and main(["drop-backup", "mine"], engine) == 0
    assert main(["backups"], engine) == 0 and name in capsys.readouterr().out and engine.documents().count() == 3


def test_a_failing_keyword_index_is_a_warning(engine, library, monkeypatch):
    engine.sync()
    (library / "three.txt").write_text("A waterfall by the mill.\n")
    monkeypatch.setattr(E.Engine, "_keyword", lambda *a: (_ for _ in ()).throw(RuntimeError("no space")))
    report = engine.sync()
    assert "no space" in report["index"]["warnings"]["p1"] and report["index"]["indexed"] == 1
    assert engine.search("waterfall mill", mode="semantic", limit=1)[0]["title"] == "three"
    monkeypatch.undo()
    assert len(engine.search("mill", mode="keyword", group_by_doc=True)) == 2
    assert engine.index()["warnings"] == {}
    assert len(engine.search("mill", mode="keyword", group_by_doc=True)) == 3


def test_files_left_out_are_reported(engine):
    assert engine.sync(index=False)["left_out"] == {"files": {"files": 1, "first": [("bad.md", "not UTF-8")]}}


def test_filters_and_modes(spark):
    assert [R.Mode.parse(m) for m in ("hybrid", "HYBRID", "Semantic")] == [R.Mode.HYBRID, R.Mode.HYBRID, R.Mode.SEMANTIC]
    with pytest.raises(ValueError, match="fuzzy"):
        R.Mode.parse("fuzzy")
    assert (R.candidates(25, 5), R.candidates(200, 5)) == (125, 500)
    doc = spark.createDataFrame([("d", "guide", "internal", False, "a/b.md", "2026-04-15T00:00:00Z", '{"area":"x","n":1.0}')], "doc_id string, doc_type string, classification string, deleted boolean, external_id string, source_updated_at string, frontmatter_json string")
    ok = lambda **k: doc.where(R.SearchFilter(**k).predicate()).count() == 1
    assert ok() and ok(doc_type="guide") and not ok(doc_type="Guide") and not ok(classification="public")
    assert ok(path_includes=["zz", "a/"]) and not ok(path_includes=["zz"]) and not ok(path_excludes=["b.md"])
    assert ok(since="2026-04-01T00:00:00Z") and not ok(since="2026-05-01T00:00:00Z") and ok(since="2026-04-15T02:00:00+02:00")
    assert ok(frontmatter={"area": "x", "n": "1.0"}) and not ok(frontmatter={"area": "x", "n": "2"}) and not ok(frontmatter={"none": "x"})


def test_results_are_grouped_and_deduplicated(spark):
    hits = spark.createDataFrame([("d1", "f", "a", 0.5), ("d1", "f", "b", 0.9), ("d2", "g", "c", 0.7), ("d2", "g", "c", 0.6)], "doc_id string, file string, text string, score double")
    assert [(r.doc_id, r.score, r.chunk_count) for r in R.document_results(hits, 9).collect()] == [("d1", 0.9, 2), ("d2", 0.7, 2)]
    assert [r.text for r in R.chunk_results(hits, 9).collect()] == ["b", "c", "a"]


def test_folders(spark):
    rows = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "D", None), (5, "E", 99), (6, "x", 7), (7, "y", 6)], schemas.FOLDERS)
    assert {r.id: r.path for r in folders.folder_paths(rows).collect()} == {1: "/A", 2: "/A/B", 3: "/A/B/C", 4: "/D", 5: "/E", 6: "/x", 7: "/y"}
    ids = lambda i: sorted(r.id for r in folders.subtree(rows, i).collect())
    assert ids(1) == [1, 2, 3] and ids(3) == [3] and ids(42) == [42] and ids(6) == [6, 7]
    assert [r.id for r in folders.find_by_path(rows, "/a/b").collect()] == [2]
    deep = spark.createDataFrame([(i, f"n{i}", i - 1 if i else None) for i in range(320)], schemas.FOLDERS)
    paths = {r.id: r.path for r in folders.folder_paths(deep).collect()}
    assert paths[319] == "".join(f"/n{i}" for i in range(320)) and folders.subtree(deep, 20).count() == 300


def test_test_cases(spark):
    steps = [(2, "<b>do</b>", None, "<p>ok</p>", None), (None, "first", "data", None, {"z": "1", "a": "x"})]
    rows = [
        (1, "K-1", "Name: x", (3, None), (5, None), (6, "High"), "me", "<p>why</p>", "", ["l1", "l2"], steps, None, True, [("J-1", None), (None, "http://u")], "2024-01-01T00:00:00Z", None),
        (2, "K-2", "bare", None, None, None, None, None, None, None, None, "run it", True, None, None, None), (3, "K-3", "none", (99, None), None, None, None, "", None, [], [], None, False, [], None, None),
    ]
    cases = spark.createDataFrame(rows, schemas.TEST_CASES)
    folder_rows = spark.createDataFrame([(1, "Root", None), (3, "Leaf", 1)], schemas.FOLDERS)
    statuses = spark.createDataFrame([(5, "Draft")], "id long, name string")
    out = {r.source.external_id: r for r in testcases.envelopes(cases, folder_rows, statuses, statuses, "K").collect()}
    one = out["K-1"].document.markdown
    assert one.startswith('---\nkey: K-1\nname: "Name: x"\nproject: K\nfolder: /Root/Leaf\nstatus: Draft\npriority: High\nowner: me\nlabels: [l1, l2]\nlinks:\n  - issue: J-1\n  - url: http://u\n')
    assert one.index("### Step 1\n") < one.index("first") < one.index("### Step 2 (Index 2)") < one.index("**do**") and "- `a`: x\n- `z`: 1\n" in one and "## Objective\n\nwhy" in one and "Precondition" not in one
    assert "```text\nrun it\n```" in out["K-2"].document.markdown and "folder: (unfiled)" in out["K-2"].document.markdown and "status: Unknown" in out["K-2"].document.markdown
    assert "_No test steps available._" in out["K-3"].document.markdown
    assert [r.source.external_id for r in testcases.envelopes(cases, folder_rows, statuses, statuses, "K", "/root").collect()] == ["K-1"]
    with pytest.raises(ValueError, match="not found"):
        testcases.envelopes(cases, folder_rows, statuses, statuses, "K", "/nowhere")


def test_pages_follow_next():
    replies = {"b/x": {"values": [1], "isLast": False, "next": "b/y"}, "b/y": {"values": [2], "isLast": False, "next": "http://z"}, "http://z": {"values": [3]}}
    assert list(testcases.pages(lambda u: replies[u.replace("b/b/", "b/")], "b", "x")) == [1, 2, 3]


def test_cases_from_json(spark):
    values = [
        {"id": 1, "key": "K-1", "name": "n", "folder": {"id": 3}, "owner": {"accountId": "acc"}, "labels": ["l"], "testScript": {"type": "steps", "steps": [{"index": 1, "description": "d", "customFields": {"a": "x", "n": 3}}]}, "createdOn": "c"},
        {"id": 2, "key": "K-2", "name": "m", "owner": "me", "testScript": None}, {"id": 3, "key": "K-3", "name": "o", "owner": 5, "testScript": {"type": "plain", "text": "t"}}, {"nothing": 1},
    ]
    raw = spark.createDataFrame([(json.dumps(v),) for v in values], "value string")
    steps = spark.createDataFrame([("K-2", json.dumps({"inline": {"index": 2, "testData": "t"}})), ("K-2", json.dumps({"inline": None}))], "key string, value string")
    links = spark.createDataFrame([("K-1", json.dumps({"issueLinks": [{"target": {"issueKey": "J-1"}}, {"target": None}], "webLinks": [{"url": "u"}]}))], "key string, value string")
    got = {r.key: r for r in testcases.parse_cases(raw, steps, links).collect()}
    assert set(got) == {"K-1", "K-2", "K-3"} and [got[k].owner for k in sorted(got)] == ["acc", "me", None]
    assert got["K-1"].steps[0].custom_fields == {"a": "x", "n": "3"} and [(x.issue_key, x.url) for x in got["K-1"].links] == [("J-1", None), (None, "u")]
    assert [s.test_data for s in got["K-2"].steps] == ["t"] and not got["K-2"].has_script and got["K-3"].script_text == "t"
    assert testcases.parse_cases(raw).schema.fieldNames() == [f.name for f in schemas.TEST_CASES.fields]


def test_cases_from_the_service(spark, engine):
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            kind = self.path.split("?")[0].removeprefix("/v2/")
            page = lambda *values, **more: {"values": list(values), "isLast": True} | more
            reply = {
                "testcases": page({"id": 1, "key": "K-1", "name": "one", "folder": {"id": 3}, "status": {"id": 5}, "testScript": {"type": "steps", "steps": [{"index": 1, "description": "inline"}]}}, isLast=False, next="testcases2"),
                "testcases2": page({"id": 2, "key": "K-2", "name": "two", "folder": {"id": 9}}), "folders": page({"id": 3, "name": "Leaf", "parentId": 1}, {"id": 1, "name": "Root", "parentId": None}),
                "statuses": page({"id": 5, "name": "Draft"}), "testcases/K-2/teststeps": page({"inline": {"index": 1, "description": "fetched"}}), "testcases/K-1/links": {"issueLinks": [{"target": {"issueKey": "J-1"}}], "webLinks": []},
            }.get(kind)
            self.send_response(200 if reply is not None and self.headers["Authorization"] == "Bearer secret" else 404)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spec = {"id": "cases", "type": "testcases", "base_url": f"http://127.0.0.1:{server.server_port}/v2/", "token": "secret", "project": "K"}
        engine.config.connectors = [spec]
        report = engine.sync(index=False)
        assert report["errors"] == {} and report["ingest"]["cases"]["written"] == 2
        docs = {r.external_id: r.markdown for r in engine.documents().collect()}
        assert "status: Draft" in docs["K-1"] and "folder: /Root/Leaf" in docs["K-1"] and "inline" in docs["K-1"] and "issue: J-1" in docs["K-1"]
        assert "fetched" in docs["K-2"] and "priority: Unknown" in docs["K-2"] and not any("K-1/teststeps" in a for a in asked)
        assert [r.source.external_id for r in engine.connector(spec | {"folder_path": "/root"}).collect()] == ["K-1"]
        with pytest.raises(Exception, match="404"):
            engine.connector(spec | {"token": "wrong"}).collect()
    finally:
        server.shutdown()


def test_owner_and_unions(spark):
    df = spark.createDataFrame([('"me"',), ('{"accountId":"a"}',), ("3",), (None,)], "o string")
    assert [r[0] for r in df.select(testcases.owner_text(F.col("o"))).collect()] == ["me", "a", None, None]


def test_configuration(tmp_path):
    with pytest.raises(ConfigError):
        Config(home="h", profiles=[Profile("c", locality="cloud")])
    with pytest.raises(ConfigError):
        Config(home="h", routing={"public": "nobody"})
    assert Config(home="h", generation=" g-1 ").generation == "g-1" and Config(home="h", generation="no way").generation == "gen_default"
    file = tmp_path / "c.yaml"
    file.write_text("profiles: [{id: a, model: m}]\ntop_k: 9\nconnectors: [{id: z}, {id: b, enabled: false}, {id: a}]\n")
    c = Config.load(str(file), {"LODESEAM_HOME": "/x", "LODESEAM_TOP_K": "7"})
    assert (c.home, c.top_k, c.default_profile) == ("/x", 7, "a")
    assert [x["id"] for x in c.select_connectors()] == ["a", "z"] and [x["id"] for x in c.select_connectors(["b"], True)] == ["b"]
    assert key_value(" a = b=c ") == ("a", "b=c") and expand("~x") == "~x"
    with pytest.raises(ValueError, match="KEY=VALUE"):
        key_value("a")


def test_streamed_ingest(spark, engine, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    envelope = {"schema_version": 1, "source": {"plugin_id": "s", "connector_instance": "s", "external_id": "e"}, "document": {"doc_id": "s:1", "title": "t", "markdown": "a mill", "content_hash": "sha256:" + "0" * 64, "source_updated_at": "2024-01-01T00:00:00Z", "deleted": False}, "metadata": {"doc_type": "note", "classification": "public"}}
    (landing / "1.json").write_text(json.dumps(envelope) + "\n")
    query = stream.start(engine, str(landing), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert query.exception() is None and engine.documents().count() == 1
