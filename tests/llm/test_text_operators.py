import hashlib
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseam.llm import common, decontaminate, likeness, lines, order_minhash, packing, substrings, token_counts

from .edge import no_documents, odd_documents, prose

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------- shared pieces


def test_words_and_windows():
    texts = ["a  bb\tccc", "", None, "\n", "é 中🙂 x"]
    w = common.Words(pa.array(texts), common.NOT_SPACE)
    assert w.counts.tolist() == [3, 0, 0, 0, 3]
    assert [w.raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == ["a", "bb", "ccc", "é", "中🙂", "x"]
    ids = common.Words(pa.array(["a b a b", "b a b"]), common.NOT_SPACE).ids()
    assert ids[0] == ids[2] == ids[5] and ids[1] == ids[3] == ids[4] != ids[0]
    h = common.window_hash(ids, 2)
    assert h[0] == h[2] == h[5] and h[1] == h[4]
    assert common.Words(pa.array(["A1-b É"]), common.ALNUM, lower=True).counts.tolist() == [3]


@pytest.mark.parametrize("values", [[], [5], [-9, -9, 0, 300, 1 << 40], list(range(0, 3000, 7))])
def test_packed_integers_round_trip(values):
    assert common.unpack_sorted(common.pack_sorted(np.array(values, np.int64))).tolist() == values


# ---------------------------------------------------------------- 1: substrings


def brute_substrings(rows, size=13):
    where = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, ws in split:
        if d is not None:
            for i in range(len(ws) - size + 1):
                k = tuple(ws[i : i + size])
                where[k] = min(where.get(k, d), d)
    out = []
    for d, ws in split:
        gone = set()
        if d is not None:
            for i in range(len(ws) - size + 1):
                if where[tuple(ws[i : i + size])] < d:
                    gone.update(range(i, i + size))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_substrings_on_odd_documents(spark):
    docs = odd_documents(spark)
    got = substrings.repeated_words(docs)
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings([(r.doc_id, r.text) for r in docs.collect()])
    assert substrings.repeated_words(no_documents(spark)).count() == 0


def test_substrings_with_small_shards_and_passages_that_many_share(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WINDOWS", 50)
    passage = prose(3, 60)
    rows = [(i, " ".join([prose(50 + i, 20), passage if i % 3 == 0 else prose(900 + i % 4, 15), prose(400 + i, 9)])) for i in range(60)]
    got = substrings.repeated_words(docs_of(spark, rows))
    assert as_rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


# ---------------------------------------------------------------- 2: lines


def brute_lines(rows, least=0.8):
    """Lines kept of (doc_id, text) rows with distinct ids."""
    place = {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(t.split("\n")):
            words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[0-9]", b"0", line.encode().lower()))
            if len(words) >= lines.MIN_WORDS:
                place.setdefault(tuple(words), []).append((d, n))
    keys = sorted(place, key=lambda k: place[k][0])
    root, bags = list(range(len(keys))), [Counter(k) for k in keys]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            most = int(max(len(keys[i]), len(keys[j])) * (1 - least) + 1e-9)
            if abs(len(keys[i]) - len(keys[j])) <= most and (bags[i] - bags[j]).total() <= most and distance(keys[i], keys[j]) <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {o for i, k in enumerate(keys) for o in place[k] if o != place[keys[find(i)]][0]}
    return {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in rows if d is not None and t is not None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(seed, n, words=40):
    r, base = random.Random(seed), prose(seed, words).split()
    for k in range(n):
        w = base[:]
        for _ in range(k % 4):
            w[r.randrange(len(w))] = "".join(r.choice("qrstuv") for _ in range(4))
        yield " ".join(w).capitalize() + ("!" if k % 2 else f" {k % 10}.")


def test_lines_of_variants(spark):
    rows = [(i, "\n".join([prose(i, 14), v, "short line", v.upper() if i % 5 == 0 else prose(70 + i, 9)])) for i, v in enumerate(variants(8, 40))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)


def permuted(seed, n, words=16):
    """Lines of the same words in other orders, of which the two of a pair are alike and others mostly not: links that signatures allow fail."""
    r = random.Random(seed)
    for i in range(n):
        w = prose(33, words).split()
        r.shuffle(w)
        yield " ".join(w)
        w[3] = w[3] + "x" if i % 2 else w[3]
        yield " ".join(w)


@pytest.mark.parametrize("hot", [4096, 5])
def test_lines_in_large_buckets_lose_no_link(spark, monkeypatch, hot):
    """Forests' failed links are found again in rounds; buckets over the limit are dealt into cells."""
    monkeypatch.setattr(likeness, "HOT", hot)
    monkeypatch.setattr(likeness, "PART", 3)
    monkeypatch.setattr(likeness, "FIRST", 1)
    monkeypatch.setattr(likeness, "MORE", 2)
    rows = [(i, v) for i, v in enumerate([*variants(21, 50), *variants(22, 30, 12)])]
    passage = prose(34, 9)
    rows += [(200 + i, passage + " " + v) for i, v in enumerate(permuted(4, 12))]
    rows += [(300 + i, passage + " " + " ".join(prose(500, 20 + i % 3).split()[::-1][i % 5 :])) for i in range(20)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)


def templated(n, common, own, seed=1):
    """Lines that share ``common`` words and have ``own`` words each."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    shared, out = [word() for _ in range(common)], []
    for _ in range(n):
        line = list(shared)
        for _ in range(own):
            line.insert(draw.randint(0, len(line)), word())
        out.append(" ".join(line))
    return out


def test_templated_lines_stay_cheap(spark):
    """Lines of one template, each as unlike the others as the threshold forbids, are neither lost nor compared all with all."""
    texts = templated(4000, 15, 5)
    texts += [texts[0], " ".join(["other", *texts[1].split()[1:]])]
    docs = spark.createDataFrame([(i, "\n".join(texts[i * 10 : i * 10 + 10])) for i in range(401)], "doc_id long, text string")
    began = time.time()
    assert lines.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 2
    assert time.time() - began < 150


def test_split_buckets_hold_every_like_pair():
    draw = np.random.default_rng(8)
    many = []
    for _ in range(150):
        base = draw.integers(0, 40, int(draw.integers(4, 40)))
        for _ in range(3):
            other = base.copy()
            other[draw.random(len(base)) < 0.12] = draw.integers(0, 40)
            many.append(np.append(other, draw.integers(0, 40, int(draw.integers(0, 3)))).astype(np.uint32))
    ids = np.arange(len(many), dtype=np.int64) * 7 - 50
    blobs = []
    for batch in (pa.record_batch([pa.array(ids), pa.array([m.tobytes() for m in many], pa.binary())], ["id", "words"]),):
        for out in likeness.wide_cells(iter([batch])):
            blobs += [int(i).to_bytes(8, "little", signed=True) + len(x).to_bytes(4, "little") + x for i, x in zip(out.column("id").to_pylist(), out.column("wide").to_pylist(), strict=True)]
    wide = likeness.Wide(blobs, ids)
    met = set()
    for idx in wide.finer(np.arange(len(many)), 0.8):
        for row in idx:
            row = row[row >= 0].tolist()
            met |= {(a, b) for a in row for b in row if a < b}
    like = {(a, b) for a in range(len(many)) for b in range(a + 1, len(many)) if likeness.alignment_distance(many[a], many[b], most := int(max(len(many[a]), len(many[b])) * 0.2 + 1e-9)) <= most}
    assert len(like) > 100 and like <= met and len(met) < len(many) ** 2 / 3


def test_forests_span_what_signatures_allow():
    r = random.Random(5)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "e", "f", "g", "h"]) + str(r.randrange(3)) for _ in range(n)) for n in (6, 6, 7, 30, 31, 100, 101, 500, 510) for _ in range(9)]
    w = common.Words(pa.array(texts), common.ALNUM)
    ids, n = w.ids(), w.counts
    sigs = likeness.Signatures(likeness.signatures(ids, w.first), n, 0.8)
    idx = np.full((3, 40), -1)
    idx[0, :40], idx[1, :11], idx[2, :30] = np.arange(40), np.arange(40, 51), np.arange(51, 81)
    i, j, _ = likeness.spanning_forest(sigs, idx)

    def parts(pairs):
        root = list(range(len(texts)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(texts))]

    every = [(a, b) for row in idx for a in row[row >= 0] for b in row[row >= 0] if a < b and sigs.weight(np.array([a]), np.array([b]))[0] < likeness._NONE]
    assert parts(zip(i.tolist(), j.tolist())) == parts(every) and len(i) == len(texts) - len(set(parts(every)))


def test_many_alignments_at_once():
    r, pairs, most, want = random.Random(1), [], [], []
    for _ in range(400):
        a = [r.randint(0, r.choice([2, 6, 50])) for _ in range(r.choice([0, 1, 20, 60, 700]))]
        b = a[:]
        for _ in range(r.randint(0, 14)):
            k = r.random()
            if k < 0.4 and b:
                b[r.randrange(len(b))] = r.randint(0, 9)
            elif k < 0.7 and b:
                del b[r.randrange(len(b))]
            else:
                b.insert(r.randint(0, len(b)), r.randint(0, 9))
        m = int(max(len(a), len(b)) * r.choice([0.02, 0.2, 0.5]))
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
        most.append(m)
        want.append(likeness.alignment_distance(*pairs[-1], m) <= m if len(a) > 100 else distance(a, b) <= m)
    assert likeness.within(pairs, np.array(most)).tolist() == want


def test_like_lines_share_a_key():
    """Recall against all pairs by plain edit distance, in bands of similarity and length; edits fall anywhere."""
    r, total, found = random.Random(12), Counter(), Counter()
    for n in (5, 8, 10, 15, 20, 30, 50):
        for share in (0.2, 0.1, 0.05):
            edits = int(n * share + 1e-9)
            for k in range(40 if edits else 0):
                base = prose(1000 * n + k, n).split()
                w = base[:]
                for i in r.sample(range(n), edits):
                    w[i] = "changed" + w[i]
                x = common.Words(pa.array([" ".join(base), " ".join(w)]), common.ALNUM)
                many, keys = lines.line_keys(x.ids(), x.first)
                total[n, share] += 1
                found[n, share] += bool(set(keys[: many[0]].tolist()) & set(keys[many[0] :].tolist()))
    assert all(found[k] == total[k] for k in total if k[0] <= 18) and all(found[k] >= 0.95 * total[k] for k in total)


def test_like_lines_of_a_corpus_are_found(spark):
    """On real lines of 4 to 60 words, components equal those of all pairs."""
    rows = [(r.doc_id, "\n".join(x for x in r.text.split("\n") if 4 <= len(x.split()) <= 60)[:4000]) for r in common.table(spark, SF, "documents").collect()]
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_signatures_never_exclude_like_sequences():
    r = random.Random(6)
    for n in (5, 9, 10, 40, 80, 85, 200, 400, 430, 5000):
        base = [f"w{r.randrange(400)}" for _ in range(n)]
        for _ in range(20):
            w = base[:]
            for _ in range(n // 5):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"v{r.randrange(90)}"], [f"v{r.randrange(90)}"]])
            x = common.Words(pa.array([" ".join(base), " ".join(w)]), common.ALNUM)
            sigs = likeness.Signatures(likeness.signatures(x.ids(), x.first), x.counts, 0.8)
            assert sigs.weight(np.array([0]), np.array([1]))[0] < likeness._NONE


def test_lines_at_the_threshold_are_linked(spark):
    """A fifth of the words replaced, evenly spread, or a frequent word more often: alike, whatever SimHash says."""
    rows = []
    for i, n in enumerate((5, 7, 9, 10, 12, 15, 17, 20, 22, 40, 120, 700)):
        base = [f"w{chr(97 + i)}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
        w = ["other" + x if k % 5 == 2 else x for k, x in enumerate(base)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join([*base[:2], "other", *base[3:]] if n < 10 else w))]
    rows += [(1000, "so " * 20 + "it was"), (1001, "so " * 22 + "it was"), (1002, "nothing of this has been said before today")]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert [d for d, n in sorted(got.items()) if not n] == sorted([10 * i for i in range(12)] + [1000, 1002])


def test_short_lines_are_compared(spark):
    rows = [(1, "Chapter one\n}\n\nsee also:\nin all this"), (2, "CHAPTER ONE\n}\n\nSee also\nin all that"), (3, "chapter\n{\n\nsee  also\nall this")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "}\n\nin all that", 3: "chapter\n{\n\nall this"}


def test_lines_on_odd_documents(spark):
    docs = odd_documents(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert by[1][0].text == texts[1] and [r.text for r in by[2]] == ["", ""]  # repeated rows alike
    assert all(r.n_removed == 0 for r in by[None]) and by[4][0].text is None and by[6][0].text == texts[6]
    assert by[7][0].text == texts[7] and by[8][0].n_removed >= 499
    assert by[11][0].n_removed == 3 and by[12][0].n_removed == 1
    assert lines.dedup_lines(no_documents(spark)).count() == 0


# ---------------------------------------------------------------- 7: decontamination


def test_contamination_on_odd_documents(spark):
    words = prose(60, 40).split()
    items = spark.createDataFrame([(1, " ".join(words[:12])), (10, " ".join(words[5:9])), (2, ""), (3, None), (None, " ".join(words[30:])), (1, " ".join(words[:12])), (4, "Solo")], "item_id long, text string")
    text = lambda *p: " ".join(p)
    rows = [(1, text("a", *words[:10], "b")), (2, text(*words[:9])), (3, text(*(w.upper() + "," for w in words))), (4, None), (5, ""), (6, "say SOLO! twice solo"), (None, "solo"), (7, text(*words[1:11], *words[2:12]))]
    docs = docs_of(spark, rows).withColumn("spans", F.lit("clash")).withColumn("items", F.lit(1))
    for block_rows in (1 << 18, 3):  # one block, and several that a row passes in turn
        got = {r.doc_id: r for r in decontaminate.summarise(decontaminate.find_items(docs, items, block_rows=block_rows)).collect()}
        names = lambda *n: hashlib.sha256(",".join(sorted(n)).encode()).hexdigest()
        assert (got[1].n_words, got[1].n_hit, got[1].items_sha256) == (12, 10, names("1", "10"))
        assert (got[2].n_hit, got[2].items_sha256) == (4, names("10"))
        assert (got[3].n_hit, got[3].n_items) == (22, 3) and got[3].items_sha256 == names("", "1", "10")
        assert (got[4].n_words, got[4].contaminated) == (0, False) and not got[5].contaminated
        assert (got[6].n_hit, got[None].n_hit, got[7].n_hit) == (2, 1, 20)
    none = items.where("false")
    assert decontaminate.summarise(decontaminate.find_items(docs, none)).where("contaminated").count() == 0
    assert decontaminate.summarise(decontaminate.find_items(odd_documents(spark), none)).count() == 16
    assert decontaminate.find_items(no_documents(spark), items).count() == 0


# ---------------------------------------------------------------- 8: packing


def check_packing(spark, docs, window=4096, grid=16):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = [r.asDict() for r in packing.pack(docs, window=window, grid=grid).collect()]
    want = sorted((str(r.doc_id), [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    pieces = {}
    for r in out:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        pieces.setdefault((str(r["doc_id"]), r["doc_tokens"]), []).append(r)
    got = []
    for (name, n), rows in pieces.items():
        rows.sort(key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(r["start"] == 0 for r in rows)
        assert sum(r["length"] for r in rows) == copies * n
        if copies == 1:
            got.append((name, np.frombuffer(b"".join(r["ids"] for r in rows), "<u4").tolist()))
    assert all(x in want for x in got)
    assert len(want) - len(got) == sum(sum(r["start"] == 0 for r in rows) for rows in pieces.values() if sum(r["start"] == 0 for r in rows) > 1)
    padding = 0
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(sequences) == list(range(len(sequences)))
    return padding, sum(r["length"] for r in out)


def test_packing_of_documents(spark):
    padding, tokens = check_packing(spark, common.table(spark, SF, "documents").select("doc_id", "text"))
    assert padding < 0.02 * tokens


def test_packing_of_odd_documents(spark):
    check_packing(spark, odd_documents(spark))
    assert packing.pack(no_documents(spark)).count() == 0
    check_packing(spark, docs_of(spark, [(1, None)]))
    check_packing(spark, docs_of(spark, [(i, prose(i, i % 50)) for i in range(300)]), window=64, grid=4)


def test_word_encoder_equals_the_tokenizer():
    encoder = packing.WordEncoder(packing.default_tokenizer())
    r = random.Random(2)
    letters = " \t\n\x0b\x0c\r\x1c\x85\xa0　aBsSΣσÉé'́,.!|<>0١½ẞßİJ̌한中🙂‍̸=_-…"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) + r.choice(["", "<|endoftext|>", " I'll don't' S "]) for _ in range(4000)]
    for t, ids in zip(texts, encoder.batch(pa.array(texts))):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_least_squares_never_overuses_a_slot():
    histogram = np.bincount(np.random.default_rng(1).integers(1, 65, 5000), minlength=65)
    combos = packing.fill(histogram, 64)
    counts = packing.solve(combos, histogram)
    assert (combos.sum(1) == 64).all()
    used = np.bincount(combos.ravel(), weights=np.repeat(counts, 3), minlength=65)
    used[0] = 0
    assert (used <= histogram).all() and used.sum() > 0.9 * histogram.sum()


def test_greedy_windows_use_no_slot_twice_and_are_full():
    r = np.random.default_rng(5)
    for _ in range(60):
        left = r.integers(0, r.choice([2, 5, 2000]), 65) * (r.random(65) < r.choice([0.05, 0.5, 1.0]))
        windows = packing.greedy(left, 64, 1)
        used = sum((need * n for need, n in windows), np.zeros(65, np.int64))
        assert (used[1:] <= left[1:]).all() and used[0] == 0
        assert all(n > 0 and 63 <= (need * np.arange(65)).sum() <= 64 for need, n in windows)
        assert len(windows) < 65 * 12
    # each size by itself: those that divide a window are packed, the others stay over
    assert [int(n) for _, n in packing.greedy(np.bincount([32] * 9, minlength=65), 64, 0)] == [4]
    assert packing.greedy(np.bincount([40] * 9, minlength=65), 64, 0) == []


def test_few_documents_are_cut(spark):
    docs = docs_of(spark, [(i, prose(i, 20 + i * 37 % 400)) for i in range(1500)])
    pieces = packing.pack(docs, window=512, grid=4, with_ids=False)
    whole = pieces.where("doc_tokens < 512").groupBy("doc_id").count()
    assert whole.where("count > 1").count() < 0.05 * whole.count()


# ---------------------------------------------------------------- 9: near duplicates


def test_alignment_distance():
    r = random.Random(0)
    for _ in range(600):
        a = [r.randint(0, r.choice([2, 6, 50])) for _ in range(r.randint(0, 30))]
        b = a[:]
        for _ in range(r.randint(0, 8)):
            k = r.random()
            if k < 0.4 and b:
                b[r.randrange(len(b))] = r.randint(0, 9)
            elif k < 0.7 and b:
                del b[r.randrange(len(b))]
            else:
                b.insert(r.randint(0, len(b)), r.randint(0, 9))
        d, most = distance(a, b), r.randint(0, 35)
        assert likeness.alignment_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == (d if d <= most else most + 1)


def brute_groups(rows, least=0.8):
    split = [(d, re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())) for d, t in rows]
    root = {d: d for d, _ in split}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, a) in enumerate(split):
        for e, b in split[:i]:
            n = max(len(a), len(b))
            if a and b and (a == b or (min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 0.2 * n and distance(a, b) <= int(n * (1 - least) + 1e-9))):
                x, y = sorted((find(d), find(e)))
                root[y] = x
    return {d: find(d) for d, _ in split}


def test_near_groups_of_edited_copies(spark):
    rows, r = [], random.Random(6)
    for g in range(12):
        base = prose(1000 + g, 90).split()
        for k in range(6):
            w = base[:]
            for _ in range(r.randint(0, 6)):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([[], ["new"], [w[i], "put"]])
            rows.append((len(rows), " ".join(w) + (" " + prose(77, 30) if g < 4 else "")))
    rows += [(500 + i, prose(5000 + i, 60) + " " + prose(77, 30)) for i in range(40)]
    got = {x.doc_id: x for x in order_minhash.near_groups(docs_of(spark, rows)).collect()}
    assert {d: x.group_id for d, x in got.items()} == brute_groups(rows)
    assert all(x.kept == (d == x.group_id) for d, x in got.items())


def test_near_groups_across_a_common_passage(spark):
    """Copies whose buckets are headed by a third document with the same passage are compared with each other."""
    passage, rows = prose(600, 140), []
    for i in range(60):
        own = prose(700 + i, 60).split()
        copy = own[:]
        for k in range(3, 60, 6):
            copy[k] = "changed" + copy[k]
        rows += [(i, passage + " " + " ".join(own)), (1000 + i, passage + " " + " ".join(copy))]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r.group_id for r in order_minhash.near_groups(docs).collect()}
    assert got == {d: d % 1000 for d, _ in rows}


def test_documents_at_the_threshold_share_a_key():
    """Recall at similarity 0.8, edits at random places."""
    found, r = 0, random.Random(9)
    for k in range(200):
        base = prose(7000 + k, 300).split()
        edited = set(r.sample(range(300), 60))
        w = ["other" + x if i in edited else x for i, x in enumerate(base)]
        x = common.Words(pa.array([" ".join(base), " ".join(w)]), common.ALNUM)
        a, b = order_minhash.sketch(x, x.ids())
        found += bool(set(a.tolist()) & set(b.tolist()))
    assert found >= 180


def thue_morse(n, flip):
    s = "a"
    while len(s) < n:
        s += "".join("b" if c == "a" else "a" for c in s)
    return s[:n] if not flip else "".join("b" if c == "a" else "a" for c in s[:n])


@pytest.mark.parametrize("n", [5, 10, 20, 50, 100, 159, 161, 300])
def test_short_documents_at_the_threshold_share_a_key(n):
    draw = random.Random(n)
    words = [f"w{i}" for i in range(4000)]
    left, right = [], []
    for _ in range(60):
        x = draw.choices(words, k=n)
        y = list(x)
        for i in draw.sample(range(n), n // 5):
            y[i] = "other" + draw.choice(words)
        left.append(" ".join(x))
        right.append(" ".join(y))
    b = order_minhash.document_batch(pa.record_batch([pa.array(range(120)), pa.array(range(120)), pa.array(left + right)], ["doc_id", "row", "text"]))
    at = np.cumsum([0, *b.many.astype(int)])
    keys = [set(b.keys[lo:hi].tolist()) for lo, hi in zip(at[:-1], at[1:], strict=True)]
    assert np.mean([bool(keys[i] & keys[60 + i]) for i in range(60)]) >= 0.9


def test_identities_do_not_collide_by_construction(spark):
    """Words and documents whose polynomial hashes modulo 2**64 would be equal, whatever the base."""
    sizes = (8, 9, 64, 300, 1024, 2048, 4096)
    words = [thue_morse(n, f) for n in sizes for f in (0, 1)]
    assert len(set(common.Words(pa.array([" ".join(words)]), common.NOT_SPACE).ids().tolist())) == len(words)
    texts = [" ".join(thue_morse(n, f)) for n in (1024, 2048) for f in (0, 1)]
    got = order_minhash.near_groups(docs_of(spark, list(enumerate(texts)))).collect()
    assert len({r.class_id for r in got}) == 4
    tail = prose(2, 12)
    rows = [(i, f"{w} {tail}") for i, w in enumerate(words[-6:])]
    assert as_rows(substrings.repeated_words(docs_of(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)
    items = spark.createDataFrame([(1, f"{words[-1]} {prose(2, 9)}")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.summarise(decontaminate.find_items(docs_of(spark, rows), items)).where("contaminated").collect()} == {5}
    encoder = packing.WordEncoder(packing.default_tokenizer())
    for t, ids in zip(words, encoder.batch(pa.array(words))):
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_near_groups_on_odd_documents(spark):
    got = order_minhash.near_groups(odd_documents(spark)).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(by) + 2 and sum(r.kept for r in got if r.doc_id is None) == 2
    assert by[1].group_id == by[2].group_id == by[3].group_id == 1 and by[3].class_id == 1
    assert by[8].group_id == 7 and by[8].class_id == 8
    assert all(by[d].group_id == d for d in (4, 5, 6, 9, 10, -3))
    assert order_minhash.near_groups(no_documents(spark)).count() == 0


# ---------------------------------------------------------------- 10: token counts


def test_trees_follow_edits():
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    r = random.Random(4)
    letters = " \t\n\x1c\x85\xa0　aBsΣÉ'́,.!|09١½ẞ한中🙂‍_-" + "abc " * 6
    text_of = lambda n: "".join(r.choice(letters) for _ in range(n))
    for _ in range(150):
        text = text_of(r.choice([0, 1, 5, 400, 3000]))
        tree = token_counts.CountTree(token_counts.leaves(text), None, encode)
        for _ in range(4):
            start, deleted, inserted = r.randint(0, len(text) + 3), r.choice([0, 1, 5, 50, 2000]), text_of(r.choice([0, 1, 3, 30, 4000]))
            tree.edit(start, deleted, inserted)
            start = min(start, len(text))
            text = text[:start] + inserted + text[start + deleted :]
            assert tree.text == text and tree.total == len(encode(text))


def test_cuts_are_safe_between_any_two_characters():
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    r = random.Random(12)
    letters = "aBé汉ー한'’s tmdlrev12½٣ \t\n\r\x0b\x1c\x85\xa0\u3000.,!?、。_-🙂́"
    cuts = 0
    for _ in range(6000):
        text = "".join(r.choice(letters) for _ in range(r.randint(2, 14)))
        at = r.randint(1, len(text) - 1)
        if token_counts.safe(text[:at], text[at:]):
            cuts += 1
            assert encode(text) == encode(text[:at]) + encode(text[at:]), (text, at)
    assert cuts > 2000


@pytest.mark.parametrize("unit", ["汉字汉字，没有空格的文字。", "a_b-c.d(e)[f]", "don't\n", "1a2b3c4d", "x\t\t\ny"])
def test_texts_without_spaces_have_small_leaves(unit):
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    text = unit * (200_000 // len(unit))
    parts = token_counts.leaves(text)
    assert "".join(parts) == text and max(map(len, parts)) <= token_counts.LEAF + 16
    tree = token_counts.CountTree(parts, None, encode)
    tree.encoded = 0
    for start, deleted, inserted in [(0, 0, "字"), (100_000, 7, "x'"), (50_000, 3000, ""), (len(text), 0, " s")]:
        tree.edit(start, deleted, inserted)
    assert tree.total == len(encode(tree.text)) and tree.encoded < 16 * token_counts.LEAF


def test_small_edits_encode_little_and_trees_are_kept(spark):
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    rows = [(1, prose(1, 4000)), (2, "short"), (3, None), (None, "x y")]
    edits = spark.createDataFrame([(1, 2, 9000, 4, "zz top"), (1, 1, 10, 0, "more "), (2, 1, None, None, None), (9, 1, 0, 1, "x"), (None, 1, 0, 1, "x"), (3, 1, 50, 9, "now")], "doc_id long, seq int, start long, deleted long, inserted string")
    state = token_counts.count_tokens(docs_of(spark, rows))
    out = {r.doc_id: r for r in token_counts.count_tokens(token_counts.with_edits(state.select("doc_id", "text", "leaf_chars", "leaf_tokens"), edits)).collect()}
    assert out[1].n_chars_encoded < 4 * token_counts.LEAF and out[1].n_tokens == len(encode(out[1].text)) and out[1].n_edits == 2
    assert (out[2].n_tokens, out[3].text, out[3].n_tokens, out[None].n_tokens) == (len(encode("short")), "now", len(encode("now")), len(encode("x y")))


def test_token_counts_query_and_odd_documents(spark):
    encode = token_counts.encoding(token_counts.default_ranks()).encode_ordinary
    docs = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    for r in token_counts.op10_token_counts(spark, SF).collect():
        text = docs[r.doc_id]
        assert r.n_tokens_before == len(encode(text))
        n = len(text)
        text = "Draft " + text
        text = text[: n // 2] + " changed it's " + text[n // 2 + 9 :]
        text = text[: n // 3] + text[n // 3 + 40 :] + "\nEnd of the text."
        assert (r.n_tokens, r.n_chars) == (len(encode(text)), len(text))
    assert token_counts.count_tokens(odd_documents(spark)).count() == 16 and token_counts.count_tokens(no_documents(spark)).count() == 0
