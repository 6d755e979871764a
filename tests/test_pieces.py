"""Python steps on columns hold a piece of a batch at a time, and run once."""

import pyarrow as pa
import pytest

from lodeseam import queries as core
from lodeseam.functions import batches, chunking

SF = "/root/testdata/sf0.001"
TEXTS = ["One. " * 900, None, "", "  \n", "é" * 4000, "Short.", "\n\n".join("Part é%d? " % i * 40 for i in range(30))]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_pieces_are_bounded_and_whole(kind):
    array = pa.array(["x" * (i % 50) for i in range(1000)] + ["y" * 5000, None], kind).slice(7)
    parts = list(batches.pieces(array, 300))
    assert pa.concat_arrays(parts).equals(array)
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 300 for p in parts)
    lists = pa.array([["ab"] * (i % 9) for i in range(200)] + [None, []], pa.list_(kind)).slice(3)
    parts = list(batches.pieces(lists, 40))
    assert pa.concat_arrays(parts).equals(lists)
    assert all(len(p) == 1 or sum(2 * len(ws or ()) for ws in p.to_pylist()) <= 40 for p in parts)


def test_chunk_array_equals_the_chunks_of_each_text():
    array = pa.array(["skipped", *TEXTS]).slice(1)
    want = [[] if t is None else [dict(zip(("start", "end", "text"), c, strict=True)) for c in chunking.chunks(t)] for t in TEXTS]
    assert chunking.chunk_array(array).to_pylist() == want


@pytest.mark.parametrize("name", ["chunk_documents", "chunk_counts"])
def test_texts_are_cut_once(spark, name):
    plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_texts_without_chunks_give_no_row(spark):
    found = chunking.chunk_documents(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).orderBy("doc_id", "chunk_ix").collect()
    want = [(i, k, *c) for i, t in enumerate(TEXTS) if t is not None for k, c in enumerate(chunking.chunks(t))]
    assert [(r.doc_id, r.chunk_ix, r.start, r.end, r.chunk_text) for r in found] == want
