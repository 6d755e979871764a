import random

import numpy as np

from lodeseam.llm import common, likeness, order_minhash
from lodeseam.llm.components import joined_roots


def test_each_pair_has_its_turn_in_one_bucket():
    draw = np.random.default_rng(5)
    ids = draw.integers(0, 1 << 60, 80)
    keys = [np.unique(draw.integers(1, 9, 5)).astype(np.uint64) for _ in ids]
    turns = np.zeros((80, 80), int)
    for k in range(1, 9):
        members = np.array([i for i in range(80) if k in keys[i]])
        turn = likeness.Turn(members, k, {i: keys[i] for i in members.tolist()}, ids)
        i, j = (x.ravel() for x in np.meshgrid(members, members))
        i, j = i[i < j], j[i < j]
        assert (turn.here(i, j) == turn.here(j, i)).all()
        np.add.at(turns, (i[turn.here(i, j)], j[turn.here(i, j)]), 1)
    assert all(turns[i, j] == bool(np.intersect1d(keys[i], keys[j]).size) for i in range(80) for j in range(i + 1, 80))


def test_a_cell_of_a_hot_bucket_aligns_all_that_it_holds():
    members = np.arange(3)
    turn = likeness.Turn(members, 99, {i: np.array([1, 2], np.uint64) for i in range(3)}, members + 10)
    assert turn.here(np.array([0, 0, 1]), np.array([1, 2, 2])).all()


def test_joined_components():
    c = likeness.Joined(np.array([7, 7, 3, 9, 9, 4]))
    assert c.join(np.array([0, 1, 3]), np.array([2, 2, 5])).tolist() == [True, False, True]
    assert c.label(np.array([0])) == c.label(np.array([2])) != c.label(np.array([3])) == c.label(np.array([5]))


def test_texts_of_one_passage_near_the_threshold_are_searched_in_one_round(spark, monkeypatch):
    draw = random.Random(11)
    word = lambda: f"w{draw.randrange(60)}"
    passage = [f"p{i}" for i in range(80)]
    texts = [passage + [word() for _ in range(draw.randrange(8, 32))] for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rounds, kept = [], likeness.untried_links
    monkeypatch.setattr(likeness, "untried_links", lambda *a, **k: rounds.append(1) or kept(*a, **k))
    got = {r.doc_id: r.group_id for r in order_minhash.near_groups(docs).collect()}
    number: dict[str, int] = {}
    code = [np.array([number.setdefault(w, len(number)) for w in t], np.uint32) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            most = int(max(len(code[a]), len(code[b])) * 0.2 + 1e-9)
            if root[a] != root[b] and likeness.alignment_distance(code[a], code[b], most) <= most:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert got == dict(enumerate(root))
    assert len(set(root)) > 1 and len(rounds) == 1


def near_copies(seed, groups, copies):
    """Signatures of groups of near copies, and of sequences of many lengths that share nothing but frequent words."""
    draw = np.random.default_rng(seed)
    many = []
    for size in draw.integers(10, 140, groups):
        base = draw.integers(0, 3000, size)
        for _ in range(copies):
            other = base.copy()
            other[draw.random(size) < draw.random() * 0.15] = draw.integers(0, 3000)
            many.append(np.append(other, draw.integers(0, 3000, int(draw.integers(0, 3)))))
    many += [draw.integers(0, 60, int(size)) for size in draw.integers(8, 300, 300)]
    ids = common.mix(np.concatenate(many).astype(np.uint64))
    n = np.array([len(x) for x in many])
    return likeness.Signatures(likeness.signatures(ids, np.concatenate([[0], np.cumsum(n)])), n, 0.8)


def test_forests_of_large_buckets_span_what_signatures_allow_without_comparing_all(monkeypatch):
    sigs, compared, kept = near_copies(3, 5, 150), [0], likeness.Signatures.weight
    every = np.arange(len(sigs.n))
    one, two = np.nonzero(kept(sigs, every[:, None], every[None]) < likeness._NONE)

    def counted(self, a, b, *rest):
        compared[0] += np.broadcast(a, b).size
        return kept(self, a, b, *rest)

    monkeypatch.setattr(likeness.Signatures, "weight", counted)
    i, j, w = likeness.spanning_forest(sigs, every[None])
    assert (kept(sigs, i, j) == w).all() and (w < likeness._NONE).all()
    root = joined_roots(every.copy(), i, j)
    assert (root == joined_roots(every.copy(), one, two)).all() and len(i) == len(every) - len(np.unique(root))
    assert compared[0] < len(every) ** 2 / 4


def test_turns_of_small_buckets_agree_with_those_of_large_ones():
    draw = np.random.default_rng(6)
    ids = np.sort(draw.choice(1 << 40, 60, False))
    keys = [np.unique(draw.integers(1, 9, 5)).astype(np.uint64) for _ in ids]
    turns = likeness.Turns(keys, ids)
    for k in range(1, 9):
        members = np.array([i for i in range(60) if k in keys[i]])
        i, j = (x.ravel() for x in np.meshgrid(members, members))
        i, j = i[i < j], j[i < j]
        want = likeness.Turn(members, k, {m: keys[m] for m in members.tolist()}, ids).here(i, j)
        assert (turns.here(i, j, np.full(len(i), k, np.uint64)) == want).all() and 0 < want.sum() < len(want)
    assert turns.here(np.array([0]), np.array([1]), np.array([99], np.uint64)).all()


def test_cells_count_repeats_three_by_three():
    words = [np.array([7, 7, 9, 7, 7, 7, 7, 7], np.uint32), np.zeros(0, np.uint32), np.array([9], np.uint32)]
    cell = lambda word, k: int(common.mix(np.array([word + 5 + k * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) % likeness.WIDE
    want = [sorted([cell(7, 0)] * 3 + [cell(7, 1)] * 3 + [cell(7, 2), cell(9, 0)]), [], [cell(9, 0)]]
    assert [x.tolist() for x in likeness.cells_of(words)] == want


def test_one_shift_is_never_below_the_distance():
    draw = random.Random(2)
    for _ in range(300):
        a = [draw.randrange(9) for _ in range(draw.randrange(1, 30))]
        b = a[:]
        for _ in range(draw.randrange(4)):
            b[draw.randrange(len(b))] = draw.randrange(9)
        at = draw.randrange(len(b) + 1)
        b[at:at] = [draw.randrange(9) for _ in range(draw.randrange(3))]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert likeness._one_shift(x, y) >= likeness.alignment_distance(x, y, 60)
    assert likeness._one_shift(np.array([1, 2, 3]), np.array([1, 9, 2, 3])) == 1


def test_few_keys_are_dealt_into_few_shards(spark, monkeypatch):
    """However wide the shuffle, a crowd's links are made in ``SHARDS`` shards at most."""
    seen, kept = [], likeness.near_links
    monkeypatch.setattr(likeness, "near_links", lambda rows, shards, least: seen.append(shards) or kept(rows, shards, least))
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        order_minhash.near_groups(spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen == [likeness.SHARDS]
