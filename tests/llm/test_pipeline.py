import re

import numpy as np
import pytest

import corpus_pipeline
from lodeseam.llm import common, order_minhash, quality

from .edge import no_documents, odd_documents
from .test_text_operators import brute_groups, brute_lines, check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, against a plain version of it."""
    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    model = quality.learn(quality.training_rows(docs, common.table(spark, SF, "labels")))
    table = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.count() > 0
            check_packing(spark, docs.select("doc_id", "text"))
            break
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = {r.doc_id: r.text for r in docs.collect()}
        rows = sorted(table.items())
        if name == "quality_classifier":
            tables = model.pair_tables()
            raw = {d: np.frombuffer(t.encode(), np.uint8) for d, t in rows}
            want = {d: t for d, t in rows if model.score(raw[d], np.array([0, len(raw[d])]), tables)[0] >= 0.3}
        elif name == "line_dedup":
            kept = brute_lines(rows)
            want = {d: kept[d] for d, t in rows if kept[d].strip(" \t\r\n") or kept[d] == t}
        elif name == "minhash_near_dedup":
            groups = brute_groups(rows)
            want = {d: t for d, t in rows if groups[d] == d}
        else:
            words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
            windows = {tuple(w[k : k + 10]) for r in common.table(spark, SF, "benchmark").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9)) if w}
            sizes = {len(w) for w in windows}
            want = {d: t for d, t in rows for w in [words(t)] if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
        assert got == want, name
        assert 0 < len(got) <= len(table)
        table = got


def test_run_gives_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_stages_on_odd_documents(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        n = out.count()
        if make is no_documents:
            assert n == 0
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)


def test_near_stage_keeps_rows_without_an_id(spark):
    docs = odd_documents(spark)
    kept = corpus_pipeline.near_stage(spark, docs, SF)
    assert kept.where("doc_id IS NULL").count() == 2 and order_minhash.near_groups(docs).where("doc_id IS NULL").count() == 2


def test_null_texts_stay_null_and_are_packed(spark):
    docs = odd_documents(spark).where("text IS NULL")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert n == out.count() == out.where("text IS NULL").count() > 0
    assert [r.length for r in corpus_pipeline.packing_stage(spark, docs, SF).collect()] == [1] * n
