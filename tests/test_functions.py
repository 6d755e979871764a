import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseam.functions import analysis, chunking, diagrams
from lodeseam.functions import frontmatter as fm
from lodeseam.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "most", "want"),
    [(" My Folder  / Docs ", 48, "my-folder-docs"), ("___", 48, "___"), ("", 9, "unnamed"), ("ünïcode", 9, "ncode"), ("a/\\ b", 9, "a-b"), ("--", 9, "unnamed"), ("abc def", 4, "abc"), ("a.b_c-d", 48, "a.b_c-d")],
)
def test_safe_component(spark, text, most, want):
    assert one(spark, lambda c: T.safe_component(c, most), text) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""), ("plain", "plain"), ("a<br>b<BR/>c<br />d", "a\nb\nc\nd"), ("<b>x</b> <STRONG>y</STRONG>", "**x** **y**"), ("<i>x</i> <em>y</em>", "_x_ _y_"),
        ('<a class="k" href="u">t</a>', "[t](u)"), ("<a href='u'>t\nv</a>", "[t\nv](u)"), ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"), ("<p>a</p><p>b</p>", "a\n\nb"),
        ("&amp;lt; &lt;&gt;&quot;&nbsp;x", '< <>" x'), ("<x y=1>z</x>", "z"), ("a\n\n\n\n\nb", "a\n\nb"),
    ],
)
def test_html_to_md(spark, html, want):
    assert one(spark, T.html_to_md, html) == want


@pytest.mark.parametrize(("text", "want"), [("  Public\n", "public"), ("", "internal"), (" \t", "internal"), (None, "internal")])
def test_classification(spark, text, want):
    assert one(spark, T.normal_classification, text) == want


@pytest.mark.parametrize(("tags", "want"), [([" b ", "##a", "", "#", None, "a"], ["a", "b"]), ([], None), (None, None)])
def test_tags(spark, tags, want):
    assert one(spark, T.normal_tags, tags, "array<string>") == want


@pytest.mark.parametrize(
    ("text", "block", "body"),
    [
        ("---\na: 1\n---\nbody", "a: 1", "body"), ("---\na: 1\n---\n\nbody", "a: 1", "\nbody"), ("no marker", None, "no marker"), ("---\na: 1\nnever", None, "---\na: 1\nnever"),
        ("---\r\na: 1\n---\r\nb", "a: 1", "b"), ("---\na: 1\n---", "a: 1", ""), ("---\n---\n", None, "---\n---\n"),
    ],
)
def test_frontmatter_split(spark, text, block, body):
    df = spark.createDataFrame([(text,)], "x string")
    b, rest = T.frontmatter_split(F.col("x"))
    assert tuple(df.select(b, rest).first()) == (block, body)


def test_frontmatter_parse(spark):
    rows = spark.createDataFrame(
        [(1, "---\ntags: [' b ', '#a', 3]\nd: 2024-01-02\nyes: no\n---\nx"), (2, "---\n: [\n---\nx"), (3, "---\ntags: one\nk: 1.0\n---\nx"), (4, "---\n- l\n---\nx"), (5, None)], "id int, t string"
    )
    got = {r.id: (r.body, r.tags, r.frontmatter_json) for r in fm.parse_frontmatter(rows, "t").collect()}
    assert got[1] == ("x", ["a", "b"], '{"d": "2024-01-02", "tags": [" b ", "#a", 3], "yes": "no"}')
    assert got[2] == ("---\n: [\n---\nx", None, None)
    assert got[3] == ("x", None, '{"k": 1.0, "tags": "one"}')
    assert got[4] == ("x", None, None)
    assert got[5] == (None, None, None)


@pytest.mark.parametrize(
    ("json", "key", "want"), [('{"a":"x"}', "a", "x"), ('{"a":1}', "a", "1"), ('{"a":1.0}', "a", "1.0"), ('{"a":true}', "a", "true"), ('{"a":null}', "a", None), ('{"a":[1]}', "a", None), ('{"a":{}}', "a", None), ('{"b.c":"x"}', "b.c", "x"), ("[]", "a", None), ("not json", "a", None), ("{}", "a", None)]
)
def test_scalar_text(spark, json, key, want):
    assert one(spark, lambda c: fm.scalar_text(c, key), json) == want


@pytest.mark.parametrize(("when", "ok"), [("2024-01-02T03:04:05Z", True), ("2024-01-02T03:04:05.123456+02:00", True), ("2024-01-02", False), ("", False), ("2024", False), ("2024-01-02T03:04:05", False), ("2024-13-02T03:04:05Z", False)])
def test_instant(spark, when, ok):
    assert (one(spark, T.instant, when) is not None) == ok


def test_chunks_of_small_texts():
    assert chunking.chunks("") == [] and chunking.chunks(" \n\t") == []
    assert chunking.chunks("  kept as it is  ", 40, 5) == [(0, 17, "  kept as it is  ")]


def test_chunks_prefer_paragraphs_then_separators_in_order():
    text = "a" * 30 + "\n\n" + "b" * 50
    assert chunking.chunk_ranges(text.encode(), 60, 0)[0] == (0, 32)
    text = "a" * 30 + ". " + "b" * 10 + "? " + "c" * 60
    assert chunking.chunk_ranges(text.encode(), 60, 0)[0] == (0, 32)
    text = "a" * 5 + "\n\n" + "b" * 90  # too early to count
    assert chunking.chunk_ranges(text.encode(), 60, 0)[0] == (0, 60)


def test_oversize_chunks_are_cut_on_a_boundary():
    [(_, _, t), *_] = chunking.chunks("é" * 20000, 30000, 0)
    assert t.endswith("...") and len(t[:-3].encode()) == 16000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .?!\né中🙂", max_size=300), st.integers(8, 60), st.integers(0, 70))
def test_chunk_ranges_cover_the_text(text, size, overlap):
    data = text.encode()
    ranges = chunking.chunk_ranges(data, size, overlap)
    if not text.strip():
        assert ranges == []
        return
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data)
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert a < c <= b and b - a <= size
        data[a:b].decode()


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("sky", "sky"), ("é", "é")],
)
def test_stems(word, want):
    assert analysis.stem(word) == want


def test_diagram_parsing(spark):
    read = lambda text: one(spark, diagrams.diagram_column, text)
    found = read("@startuml\n' no: A -> B\nparticipant \"User\" as U\nactor 'Bob'\nU --> Server : asks\nServer <-- Db\nA ..> B\nA -|> C\n")
    assert found.entities == ["A", "B", "Bob", "C", "Db", "Server", "User"]
    assert found.relations == ["User --> Server: asks", "Server <-- Db", "A ..> B", "A -|> C"]
    late = read("a -> b\nx as a\na -> b\ny as a\na->b:\n-> c\n")
    assert late.relations == ["a -> b", "x -> b", "y -> b"] and late.entities == ["a", "b", "x", "y"]
    assert read("").entities == [] and read(None).entities == []


def test_diagram_enrichment_replaces_and_is_stable(spark):
    enrich = lambda text: one(spark, diagrams.enrich_column, text)
    text = "# t\n```puml\nA -> B\n```\nend  \n\n"
    once = enrich(text)
    assert "Entities: A, B" in once and "- A -> B" in once and once.endswith("end\n")
    again = enrich(once)
    assert again.count(diagrams.TITLE) == 1
    assert enrich("no diagram \n\n") == "no diagram\n" and enrich(None) is None and enrich("") == "\n"
    many = "```plantuml\n" + "\n".join(f"A -> B{i}" for i in range(60)) + "\n```"
    assert enrich(many).count("\n- ") == 50
    assert enrich("a\r\n```puml\r\nA -> B").endswith("- A -> B\n" + diagrams.CLOSE + "\n") and enrich(f"a\n{diagrams.OPEN}\nlost") == "a\n"
