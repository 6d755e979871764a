"""Stems of whole arrays of word lists."""

import pyarrow as pa

from lodeseam.functions import analysis


def test_stem_array_equals_the_stems_of_each_word():
    lists = pa.array([["skipped"], ["walking", "walks", None, "é"], None, [], ["walking", "ponies"]], pa.list_(pa.string())).slice(1)
    assert analysis.stem_array(lists).to_pylist() == [["walk", "walk", None, "é"], None, [], ["walk", "poni"]]
