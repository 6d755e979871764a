import pytest
from pyspark.sql import functions as F

from lodeseam import queries_indexed as Q
from lodeseam.operators import block_max
from lodeseam.operators import retrieval as R
from lodeseam.plans.scratch import written

SF = "/root/testdata/sf0.001"


def rows_of(blocks):
    return sorted((r.token, r.range, r.max_tf, r.min_dl, r.n, sorted(map(tuple, r.postings))) for r in blocks.collect())


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["the cat the", None, "", "...", "The dog", "cat " * 300, "the " * 70 + "end"] + [f"the w{i} w{i % 7} cat" for i in range(200)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_blocks_hold_every_posting_once(spark, odd):
    words = written(block_max.row_words(odd, ["doc_id"], "text"), "words")
    blocks = written(block_max.block_index(words, ["doc_id"], size=16), "blocks")
    got = blocks.select("token", F.explode("postings").alias("p")).select("p.doc_id", "p.dl", "token", "p.tf")
    want = R.postings(odd, ["doc_id"], "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("doc_id", "dl", "token", "tf").collect()))
    assert sorted(block_max.frequencies_of(blocks).collect()) == sorted(R.document_frequencies(want).collect())
    assert block_max.corpus(words).collect() == R.corpus_stats(odd, "text").collect()


def test_blocks_of_some_terms_are_those_of_the_whole_index(spark):
    every, stats, frequencies = Q.keyword_blocks(spark, SF)
    some, own_stats, own_frequencies = Q.keyword_blocks(spark, SF, ["the", "water"])
    assert rows_of(some) == rows_of(every.where("token IN ('the', 'water')")) != []
    assert own_stats.collect() == stats.collect()
    assert sorted(own_frequencies.collect()) == sorted(frequencies.where("token IN ('the', 'water')").collect())


def test_a_search_over_a_bare_table_writes_no_other_tokens_blocks(spark, monkeypatch):
    seen = []
    kept = block_max.block_max_top
    monkeypatch.setattr(block_max, "block_max_top", lambda blocks, *rest: seen.append(blocks) or kept(blocks, *rest))
    assert Q._block_top(spark, SF, ["the"]).count() == 25
    assert {r.token for r in seen[0].select("token").distinct().collect()} == {"the"}
