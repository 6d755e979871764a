"""Operators 11 to 13 against brute force, and with odd input."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import hard_negatives, license_scan, periodic_runs
from lodeseam.llm.common import ALNUM, Words, table

from ..oracle import assert_same
from .edge import no_documents, odd_documents

SF = "/root/testdata/sf0.001"

# ---------------------------------------------------------------- 11: periodic runs


def plain_runs(w, least=24, ratio=3):
    seen = {}
    for q in range(1, len(w) // ratio + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, ratio * q):
                seen.setdefault((start, i + q - start), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_are_those_of_all_periods():
    draw = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(draw.randint(1, 4)):
            w = [draw.randint(0, draw.randint(1, 3)) for _ in range(draw.randint(0, 40))]
            if len(w) > 3 and draw.random() < 0.5:
                a, q = draw.randrange(len(w)), draw.randint(1, 5)
                w = w[:a] + [w[a + (i - a) % min(q, len(w) - a)] for i in range(a, len(w))]
            docs.append(w)
        least, ratio = draw.choice([(2, 2), (5, 3), (6, 2), (24, 3)])
        first = np.cumsum([0, *map(len, docs)])
        got = periodic_runs.find_runs(np.array([x for d in docs for x in d], np.uint64), first, least, ratio)
        assert list(zip(*(x.tolist() for x in got), strict=True)) == [(a + f, n, q) for d, f in zip(docs, first.tolist(), strict=False) for a, n, q in plain_runs(d, least, ratio)]


def test_highly_periodic_texts_stay_near_linear():
    for w in ([1] * 100_000, [i % 7 for i in range(100_000)]):
        start, length, period = periodic_runs.find_runs(np.array(w, np.uint64), np.array([0, len(w)]))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [len(w)], [w[-1] and max(w) + 1 if max(w) > 1 else 1])


def test_op11_equals_brute_force(spark):
    got = {tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    expected = {plain_row(*d) for d in docs if len((d.text or "").split()) < 800}
    assert expected <= got and len(got) == len(docs) and sum(r[1] > 0 for r in expected) > 5


def test_op11_odd_input(spark):
    docs = odd_documents(spark).union(odd_documents(spark).where("doc_id IN (1, 9)").withColumn("text", F.lit("a b c " * 20 + "d")))
    out = periodic_runs.digests(periodic_runs.collapse_runs(docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"), "blk", "kept")))
    got = [tuple(r) for r in out.collect()]
    short = [r for r in docs.collect() if len((r.text or "").split()) < 5000]
    assert sorted((r for r in got if r[0] not in (7, 8)), key=str) == sorted((plain_row(r.doc_id, r.text) for r in short), key=str) and len(got) == len(short) + 2
    assert periodic_runs.digests(periodic_runs.collapse_runs(no_documents(spark))).count() == 0


# ---------------------------------------------------------------- 12: licences


def plain_matches(ws, x, least):
    out = []
    for s in range(len(ws)):
        for q in range(len(x)):
            if ws[s] == x[q] and not (s and q and ws[s - 1] == x[q - 1]):
                n = 0
                while s + n < len(ws) and q + n < len(x) and ws[s + n] == x[q + n]:
                    n += 1
                if n >= least:
                    out.append((s, q, n))
    return out


def test_automaton_finds_all_maximal_matches(monkeypatch):
    monkeypatch.setattr(license_scan, "_PART", 7)
    draw = random.Random(1)
    for _ in range(300):
        letters = "abcdef"[: draw.randint(2, 4)]
        some = lambda n, more="": " ".join(draw.choice(letters + more) for _ in range(n))  # noqa: B023, E731
        templates = [(str(i), some(draw.randint(1, 9))) for i in range(draw.randint(0, 4))]
        phrases = [(f"p{i}", some(draw.randint(1, 4))) for i in range(draw.randint(0, 3))]
        docs, least = [some(draw.randint(0, 25), "z") for _ in range(3)], draw.randint(1, 4)
        words = Words(pa.array(docs), ALNUM, lower=True)
        (at, number), found = license_scan.Scanner(templates, phrases, least, 3, 0.8).matches(words)
        places, matches = [], []
        for d, doc in enumerate(docs):
            ws, f = doc.split(), int(words.first[d])
            places += [(f + s, i) for i, (_, p) in enumerate(phrases) for s in range(len(ws)) if ws[s : s + len(p.split())] == p.split()]
            matches += [(d, t, f + s, q, n) for t, (_, x) in enumerate(templates) for s, q, n in plain_matches(ws, x.split(), least)]
        assert sorted(zip(at.tolist(), number.tolist(), strict=True)) == sorted(places)
        assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(matches)


def plain_license_row(doc_id, text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = sorted((i, label) for label, p in license_scan.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    return doc_id, len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_op12_base_equals_brute_force(spark):
    rows = license_scan.op12_license_scan(spark, SF).collect()
    assert {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows} == {plain_license_row(*d) for d in table(spark, SF, "documents").select("doc_id", "text").collect()}
    for r in rows:
        base, labels = [x for x in r.base_labels.split(",") if x], [x for x in r.labels.split(",") if x]
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1
        assert set(labels) == set(base) | {s.label for s in r.spans} and (r.score > 0) == bool(labels)


def test_edited_notices_are_found_and_other_prose_is_not(spark):
    mit = license_scan.TEMPLATES[2][1]
    edited = mit.replace("free of charge", "without any charge").replace("persons to whom", "those to whom")
    texts = ["Intro text here. " + edited + " The end.", "we permit the use of the software without restriction", "Released under the MIT License. " * 3, mit[: len(mit) // 2], "Licensed under CC BY-NC 4.0.", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert [(s.label, s.first) for s in got[0].spans] == [("mit", 3)] and 0.8 <= got[0].spans[0].share < 1
    assert got[1].spans == [] and got[3].spans == [] and got[5].n_words == 0
    assert [(s.label, s.first, s.last, s.share) for s in got[2].spans] == [("mit", 5 * i, 5 * i + 4, 1.0) for i in range(3)]
    assert [(s.label, s.share) for s in got[4].spans] == [("cc-by-nc-4.0", 1.0)] and [(p.word, p.label) for p in got[4].phrases] == [(2, "cc-by")]


def test_op12_odd_input(spark):
    docs = odd_documents(spark)
    got = license_scan.scan_licenses(docs).collect()
    assert sorted(((r.doc_id, r.n_words) for r in got), key=str) == sorted((plain_license_row(r.doc_id, r.text)[:2] for r in docs.collect()), key=str)
    assert license_scan.scan_licenses(no_documents(spark)).count() == 0
    short = license_scan.scan_licenses(docs.where("doc_id = 9"), [("a", "x"), ("b", ""), ("c", "x")], [("p", "x"), ("q", "")]).first()
    assert [(s.label, s.first, s.last) for s in short.spans] == [("a", 0, 0), ("c", 0, 0)] and [p.label for p in short.phrases] == ["p"]


# ---------------------------------------------------------------- 13: hard negatives

ODD_VECTORS = [(0, [0.5, -0.25], 1), (50, [0.5, 0.25], 1), (7, [0.5, 0.1], 0), (8, None, 1), (9, [0.5, None], 1), (10, [float("nan"), 0.0], 1), (11, [float("inf"), 0.0], 2), (None, [0.5, 0.5], 1), (12, [0.5, 0.5], None), (13, [0.1], 1), (100, [0.0, 0.0], 1), (15, [0.3, 0.1], 2), (15, [0.3, 0.1], 2), (16, [0.3, 0.1], 3), (17, [0.31, 0.1], 3), (-50, [0.4, 0.2], 4), (18, [1e300, 0.0], 1), (19, [0.25, 0.0], 1), (20, [0.25, 0.0], 1)]


@pytest.mark.parametrize("shard", [4096, 3])
def test_hard_negatives_of_odd_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "BLOCK", 2)
    odd = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in ODD_VECTORS], "vec_id long, embedding array<double>, label int, shard int, v string")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(odd, F.col("vec_id") % 50 == 0, label)
    con = duckdb.connect()
    fine = {(i, tuple(v), c) for i, v, c in ODD_VECTORS if i is not None and v and len(v) == 2 and i != 18 and c is not None}
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [(i, list(v), c) for i, v, c in fine])
    assert_same(got, con.sql(hard_negatives.SQL))
    assert hard_negatives.mine(odd.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold_and_spare_most_rows():
    draw = np.random.default_rng(2)
    vectors = np.floor(256 * draw.normal(size=(3000, 16)) / 4).astype(np.int64)
    labels = draw.integers(0, 5, 3000)
    file = hard_negatives.File(np.arange(3000), labels, vectors)
    least, most = file.bounds(vectors[0], slice(0, 3000))
    scores = file.vectors @ vectors[0]
    assert (least <= scores).all() and (scores <= most).all()
    file.seen = 0
    list(hard_negatives.positives(file, list(range(50)), labels[:50].tolist(), vectors[:50], 5))
    assert file.scored < 0.1 * file.seen
