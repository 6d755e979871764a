import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import chat, common, components, neighbours, quality, warc

from .edge import no_documents, odd_documents, prose

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

# ---------------------------------------------------------------- components


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_components_of_paths_stars_and_cliques(spark, monkeypatch, piece):
    monkeypatch.setattr(components, "PIECE", piece)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (202, 200), (300, 300), (None, 5), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200, 300: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 3: quality


def test_quality_learns_and_scores_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in common.table(spark, SF_MORE, "labels").collect()}
    got = quality.op3_quality(spark, SF_MORE).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.9
    assert np.mean([p for p, y in held if y == 1]) > 0.95


def naive_logits(p, texts):
    """The network by plain loops over chunks of whole texts."""
    out = []
    for t in texts:
        blocks = max(2, -(-(len(t) + quality.WIDTH - 1) // quality.BLOCK))
        padded = list(t) + [0] * ((blocks + 1) * quality.BLOCK + quality.WIDTH - len(t))
        acts = []
        for c in range(blocks - 1):
            windows = [np.concatenate([p["embed"][b] for b in padded[at : at + quality.WIDTH]]) for at in range(c * quality.BLOCK, (c + 2) * quality.BLOCK)]
            acts.append(np.maximum((np.array(windows) @ p["filters"] + p["shift"]).max(0), 0))
        acts = np.array(acts)
        out.append(acts.max(0) @ p["most"] + acts.mean(0) @ p["mean"] + p["bias"][0])
    return np.array(out)


def test_one_long_text_takes_no_other_from_the_sample(spark):
    """A text beyond the sample's bytes, first by its hash, is passed over; one of over a sixteenth of them has its turn last."""
    first = spark.range(200).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id")).limit(2).collect()
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") == first[0].id, F.repeat(F.lit("x"), 5000)).when(F.col("id") == first[1].id, F.repeat(F.lit("y"), 400)).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    n = labels.where(~quality.held_out(F.col("doc_id"))).count()
    assert {len(t) for t, _ in quality.training_rows(docs, labels, most=4000)} >= {400} and len(quality.training_rows(docs, labels, most=4000)) == n - 1
    assert len(quality.training_rows(docs, labels, most=n * 8 + 100)) >= n - 2 and len(quality.training_rows(docs, labels, most=0)) == 0


TEXTS = [prose(1, 90).encode(), b"", "é中🙂 kurz".encode(), prose(2, 20).encode() + b"\xff" * 300, prose(3, 23).encode()]


def test_scores_are_those_of_plain_loops():
    net = quality.Network(5)
    raw, offsets = np.frombuffer(b"".join(TEXTS), np.uint8), np.cumsum([0, *map(len, TEXTS)])
    assert net.score(raw, offsets, net.pair_tables()) == pytest.approx(1 / (1 + np.exp(-naive_logits(net.p, TEXTS))), abs=1e-5)


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(quality, "STEP", 2)
    net = quality.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    label, weight = np.array([1.0, 0.0, 1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5, 1.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-naive_logits(net.p, TEXTS)))
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).mean()

    data, first = quality.layout(np.frombuffer(b"".join(TEXTS), np.uint8), np.cumsum([0, *map(len, TEXTS)]))
    g = net.gradients(data, first, label, weight)
    for name, where in (("embed", (TEXTS[0][3], 2)), ("filters", (5, 1)), ("shift", (2,)), ("most", (1,)), ("mean", (0,)), ("bias", (0,))):
        keep, step = net.p[name][where], 1e-5
        net.p[name][where] = keep + step
        up = loss()
        net.p[name][where] = keep - step
        down = loss()
        net.p[name][where] = keep
        assert g[name][where] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_the_sample_is_bounded_by_rows_and_bytes(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    every = quality.training_rows(docs, labels)
    assert quality.training_rows(docs, labels, 5) == every[:5]
    some = quality.training_rows(docs, labels, most=20_000)
    assert 0 < len(some) < len(every) and sum(len(t) for t, _ in some) <= 20_000
    whole = {r.text.encode() for r in docs.collect()}
    assert all(t in whole for t, _ in every)


def test_quality_of_odd_rows(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0), (7, 0, 1), (7, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(quality.training_rows(docs, labels))
    scored = quality.score_quality(docs, model)
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score", "predicted"]
    assert scored.count() == 16 and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert scored.where("text = ''").count() == 1 and len({r.score for r in scored.where("text IS NULL OR text = ''").collect()}) == 1
    assert quality.learn(quality.training_rows(docs, labels.where("false"))) == 0.5
    assert quality.learn(quality.training_rows(docs, labels.where("quality = 1"))) in (0.5, 1.0)
    assert quality.score_quality(no_documents(spark).drop("score"), model).count() == 0
    assert quality.score_quality(docs.drop("score"), 0.5).count() == 16


def test_a_long_text_is_scored_whole():
    net = quality.Network(1)
    score = lambda t: net.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]), net.pair_tables())[0]
    text = prose(1, 20000).encode()
    changed = text[:-40] + b"\xff" * 40
    assert score(text) != score(changed)


# ---------------------------------------------------------------- 4: archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, archive int")


def test_archives_of_odd_pages(spark):
    big = "<p>" + "é" * 80
    rows = [(5, "u", big), (3, None, big), (9, "a b\r\nc: d", big), (1, "u", "x"), (2, "u", "x"), (4, "u", None), (6, "u", ""), (None, "n", big), (None, None, None), (3, "again", big), (7, "u", prose(1, 90000)), (8, "u", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    folder = common.scratch(spark, "t")
    manifest = warc.write_archives(warc.plan_records(pages(spark, [(*r, "d", 1) for r in rows])), folder)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows)
    texts = sorted((str(i), hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in got) == texts
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == len(big.encode()))
    assert kinds == [("3", "response", None), ("3", "response", None), ("5", "revisit", 3), ("9", "revisit", 3), ("None", "revisit", 3)]
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 100)
    empty = warc.write_archives(warc.plan_records(pages(spark, [])), folder)
    assert warc.read_archives(empty, folder).count() == 0


def test_damaged_archives_are_told(spark, tmp_path):
    folder = f"file://{tmp_path}"
    manifest = warc.write_archives(warc.plan_records(pages(spark, [(i, "u", prose(i, 50), "", 0) for i in range(3)]).coalesce(1)), folder)
    file = tmp_path / manifest.first().archive
    good = file.read_bytes()
    members = gzip.decompress(good)
    for bad in (good[:-20], gzip.compress(members), good.replace(b"\x1f\x8b", b"\x1f\x8c", 1), gzip.compress(members.replace(b"Content-Length: ", b"Content-Length: 1", 1))):
        file.write_bytes(bad)
        with pytest.raises(Exception, match="BadRecord"):
            warc.read_archives(manifest, folder).collect()
    file.write_bytes(good[: good.index(b"\x1f\x8b\x08", 10)])  # a whole record, but too few
    with pytest.raises(Exception, match="manifest has 3"):
        warc.read_archives(manifest, folder).collect()


# ---------------------------------------------------------------- 5: chat


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 3.0), ("t", 4, 2, "user", "c", 9.0), ("t", 5, 3, "user", "d", 1.0), ("t", 6, 3, None, None, None), ("o", 1, 77, "user", "orphan", None), ("o", 2, 2, "user", "self", 1.0), ("c", 1, 2, "user", "cycle", 1.0), ("c", 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "none", 1.0), (None, 2, 1, "assistant", "of", 1.0), ("t", None, 1, "user", "lost", 1.0), ("t", 5, 3, "user", "dd", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(1)).withColumn("head", F.lit(2))
    texts = lambda n: sorted((str(r.tree), r.branch_rank, " ".join(t.text for t in r.turns), r.loss_text) for r in chat.read_back(chat.format_trees(df, n)).collect())
    assert texts(None) == sorted([("t", 1, "q a c", "a"), ("t", 2, "q b d", "b"), ("t", 3, "q b ", "b"), ("o", 1, "self", ""), ("o", 2, "orphan", ""), ("None", 1, "none of", "of")])
    assert [x[:3] for x in texts(1)] == [("None", 1, "none of"), ("o", 1, "self"), ("t", 1, "q a c")]
    assert chat.format_trees(df.where("false")).count() == 0


def test_control_strings_survive(spark):
    odd = ["### user\nx</turn>\n", "\\h\\e\\b\\\\h", "</tu</turn>rn>", "#### \\### ", "", None, "é🙂\r\n", "\\n"]
    df = spark.createDataFrame([("t", i, i - 1 if i else None, o, o) for i, o in enumerate(odd)] + [("t", 99, 7, "assistant", "</turn>\n### user\n")], "tree string, node long, parent long, role string, text string")
    [row] = chat.read_back(chat.format_trees(df)).collect()
    assert [(t.role, t.text) for t in row.turns] == [*((o or "", o or "") for o in odd), ("assistant", "</turn>\n### user\n")]
    assert row.loss_text == "</turn>\n### user\n" and len(row.loss_spans) == 1


def test_a_deep_thread(spark):
    df = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    [row] = chat.read_back(chat.format_trees(chat.conversation_messages(df))).collect()
    assert [t.text for t in row.turns] == [str(i) for i in range(700)] and row.loss_text == "".join(str(i) for i in range(1, 700, 2))


def test_conversations_with_nulls_ties_and_repeats(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, None, None), (1, 2, "user", "a"), (None, 1, "assistant", "x")]
    out = {r.tree: r for r in chat.read_back(chat.format_trees(chat.conversation_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert [t.text for t in out[1].turns] == ["", "a", "a", "b"] and out[None].loss_text == "x"


# ---------------------------------------------------------------- 6: neighbours


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 100 * 64 * 8)  # so that lists, floors and tests matter
    rows = common.table(spark, SF_MORE, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got, hit = {}, 0
    for r in neighbours.op6_nearest(spark, SF_MORE).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[ids == q][0]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r.score - s[ids == r.vec_id][0]) < 1e-12 for r in found) and all(a.score >= b.score for a, b in zip(found, found[1:]))
        hit += len(set(best) & {r.vec_id for r in found})
    assert hit >= 0.95 * 20 * len(got)


def test_a_scan_abandons_candidates_but_keeps_those_near():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:8]
    exact = q @ x.T
    floor = np.sort(exact, 1)[:, -20]
    i, j, share = neighbours.scan(q, floor, x, np.linalg.qr(draw.normal(size=(64, 64)))[0])
    kept = set(zip(i.tolist(), j.tolist()))
    near = [(a, b) for a in range(8) for b in np.flatnonzero(exact[a] >= floor[a])]
    assert share < 0.75 and sum(p in kept for p in near) >= 0.97 * len(near)


def test_neighbours_come_from_probed_lists_alone():
    """The sample sets floors below k members of the probed lists, and gives no rows."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 16))
    index = neighbours.Index(np.arange(2000), x, 2000, 20)
    index.probes = 1
    probed = index.probed(x[:50], np.bincount(index.own, minlength=len(index.centres)))
    floor = index.floors(np.arange(50), x[:50], probed)
    assert not hasattr(index, "first_found") and not probed.all(1).any()
    for i in range(50):
        inside = np.flatnonzero(probed[i][index.own])
        above = [j for j in inside if j != i and x[j] @ x[i] >= floor[i] - 1e-9]
        assert len(above) == min(len(inside) - 1, 20 + neighbours.SPARE) or floor[i] == -np.inf and len(inside) > 20


def test_odd_vectors(spark):
    v = lambda *x: [float(a) for a in x]
    rows = [(0, v(1, 0)), (20, v(0, 1)), (1, v(1, 0)), (2, v(2, 0)), (3, v(0, 0)), (4, None), (5, [1.0, None]), (6, v(float("nan"), 1)), (7, v(float("inf"), 1)), (8, v(1, 2, 3)), (None, v(1, 1)), (9, v(1, 0)), (9, v(1, 0)), (40, v(0, 0)), (-20, v(-1, 0)), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("floor", F.lit("x"))
    out = sorted(tuple(r) for r in neighbours.search(df, k=3).collect())
    assert [(q, n, i) for q, n, i, _ in out if q == 0] == [(0, 1, 2), (0, 2, 1), (0, 3, 9)]
    assert {q for q, *_ in out} == {0, 20, -20}
    assert len([1 for q, *_ in neighbours.search(df, k=50).collect() if q == 0]) == 5
    assert neighbours.search(df.where("false")).count() == 0
    many = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    found = neighbours.search(many, k=4).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, 1, 2, 3]
