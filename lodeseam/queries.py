"""Queries of the engine over the supplied tables, each with the SQL that states its result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import analysis, chunking, diagrams
from .functions import text as T
from .functions.embedding import service
from .functions.frontmatter import scalar_text
from .operators import catalog, folders, ingest, nearest, reconcile
from .operators import retrieval as R
from .sources import testcases

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL if there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- the corpus view


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as rows of the store; the text only if it is used."""
    d = _table(spark, sf, "documents")
    return d.select(
        F.col("doc_id"), F.concat(F.lit("doc "), F.col("doc_id")).alias("title"), F.when(F.col("source").isin("src0", "src1", "src2"), "book").otherwise("note").alias("doc_type"),
        F.element_at(F.array(*map(F.lit, T.CLASSIFICATIONS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("classification"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id"), F.lit(".md"))).alias("external_id"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_updated_at"), (F.col("doc_id") % 50 == 49).alias("deleted"),
        F.to_json(F.array("lang", "source")).alias("tags_json"), "text", "lang", "source",
    )


def corpus_with_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = _table(spark, sf, "labels").select(F.col("doc_id").alias("_l"), F.to_json(F.struct("quality", "toxic")).alias("_j"))
    c = corpus(spark, sf)
    return c.join(labels, c.doc_id == F.col("_l"), "left").withColumn("frontmatter_json", F.coalesce("_j", F.lit("{}"))).drop("_l", "_j")


_CORPUS = """
corpus AS (
  SELECT d.doc_id, 'doc ' || d.doc_id AS title, CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'book' ELSE 'note' END AS doc_type,
         ['restricted', 'confidential', 'internal', 'public'][d.doc_id % 4 + 1] AS classification, lang || '/' || source || '/' || d.doc_id || '.md' AS external_id,
         strftime(TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS source_updated_at, d.doc_id % 50 = 49 AS deleted,
         '["' || lang || '","' || source || '"]' AS tags_json, text, lang, source, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

_BM25 = r"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS ws FROM {source}),
counted AS (SELECT doc_id, len(ws) AS dl, {tfs} FROM words),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM counted),
hits AS (SELECT doc_id, {score} AS score FROM counted, stats WHERE {some})"""


def bm25_sql(terms: list[str], source: str = "documents") -> str:
    n = range(len(terms))
    term = "ln(1 + (n - df{i} + 0.5e0) / (df{i} + 0.5e0)) * tf{i} * 2.2e0 / (tf{i} + 1.2e0 * (1 - 0.75e0 + 0.75e0 * dl / avgdl))"
    return _BM25.format(
        source=source, tfs=", ".join(f"len(list_filter(ws, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(terms)), dfs=", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in n),
        score=" + ".join(term.format(i=i) for i in n), some=" OR ".join(f"tf{i} > 0" for i in n),
    )


QUERY = "the blended water"
TERMS = ["the", "blended", "water"]
N = R.candidates()


def _keyword(spark: SparkSession, sf: str, text: str = QUERY) -> DataFrame:
    return R.bm25(_table(spark, sf, "documents"), ["doc_id"], "text", text)


def _top(hits: DataFrame, n: int = 25) -> DataFrame:
    return R.top(hits, ["doc_id"], n).select("doc_id", R.rounded(F.col("score")).alias("score"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword search, filtered and grouped: the shortest way through the whole engine."""
    return filter_all(spark, sf)


# ---------------------------------------------------------------- scalar functions


@query(r"""SELECT doc_id, 'sha256:' || sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS n_bytes, substr(sha256(text), 1, 12) AS short_hash FROM documents""")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf, "documents").select("doc_id", T.content_hash(t).alias("content_hash"), F.octet_length(t).cast("long").alias("n_bytes"), T.short_hash(t, 12).alias("short_hash"))


_SAFE = r"""CASE WHEN {0} = '' THEN 'unnamed' ELSE {0} END"""


def _safe_sql(x: str, n: int) -> str:
    chain = rf"regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\s/\\]', '-', 'g')"
    chain = rf"regexp_replace(regexp_replace(regexp_replace({chain}, '[^a-z0-9_.\-]', '', 'g'), '-+', '-', 'g'), '^-', '')"
    return _SAFE.format(f"regexp_replace(substr({chain}, 1, {n}), '^-+|-+$', '', 'g')")


@query(f"SELECT page_id, {_safe_sql('url', 32)} AS slug, {_safe_sql('html', 48)} AS head FROM pages")
def safe_component(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", T.safe_component(F.col("url"), 32).alias("slug"), T.safe_component(F.col("html"), 48).alias("head"))


@query(f"WITH {_CORPUS} SELECT doc_id, classification || '/tables/' || {_safe_sql('source', 32)} || '-' || substr(sha256(source), 1, 12) || '/' || substr(sha256(external_id), 1, 24) || '.md' AS path FROM corpus")
def canonical_path(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select("doc_id", T.canonical_path(F.col("classification"), F.lit("tables"), F.col("source"), F.col("external_id")).alias("path"))


_HTML = "html"
for _p, _r in T.HTML_RULES:
    _to = _r.replace("$2", r"\2").replace("$1", r"\1").replace("\n", "' || chr(10) || '")
    _flags = "".join(c for c in "is" if _p.startswith("(?") and c in _p[2 : _p.index(")")])
    _bare = _p[_p.index(")") + 1 :] if _p.startswith("(?") else _p
    _HTML = f"regexp_replace({_HTML}, '{_bare.replace(chr(39), chr(39) * 2)}', '{_to}', 'g{_flags}')"
for _a, _b in T.ENTITIES:
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_HTML} AS markdown FROM pages")
def html_to_md(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", T.html_to_md(F.col("html")).alias("markdown"))


@query(f"WITH m AS (SELECT page_id, {_HTML} AS md FROM pages) SELECT page_id, CAST(len(regexp_extract_all(md, '\\[[^\\]]*\\]\\([^)]*\\)')) AS BIGINT) AS n_links, CAST(length(md) AS BIGINT) AS n_chars FROM m")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    m = html_to_md(spark, sf)
    return m.select("page_id", F.size(F.regexp_extract_all("markdown", F.lit(r"\[[^\]]*\]\([^)]*\)"), F.lit(0))).cast("long").alias("n_links"), F.length("markdown").cast("long").alias("n_chars"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'internal' WHEN 1 THEN 'public' WHEN 2 THEN 'restricted' ELSE lower(lang) END AS classification,
 CASE doc_id % 3 WHEN 0 THEN 'gen_default' WHEN 1 THEN 'gen-' || doc_id ELSE 'a.b_' || lang END AS generation FROM documents""")
def classification_norm(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    c = F.when(F.col("doc_id") % 5 == 0, F.lit(" \t")).when(F.col("doc_id") % 5 == 1, F.lit(" Public\n")).when(F.col("doc_id") % 5 == 2, F.lit("RESTRICTED")).otherwise(F.upper("lang"))
    g = F.when(F.col("doc_id") % 3 == 0, F.lit("not valid!")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" gen-"), "doc_id", F.lit(" "))).otherwise(F.concat(F.lit("a.b_"), "lang"))
    return d.select("doc_id", T.normal_classification(c).alias("classification"), T.normal_generation(g).alias("generation"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'k: ' || lang END AS block,
 CASE doc_id % 4 WHEN 3 THEN '---' || chr(10) || text WHEN 2 THEN '' ELSE text END AS body FROM documents""")
def frontmatter_split(spark: SparkSession, sf: str) -> DataFrame:
    k, i = F.concat(F.lit("k: "), "lang"), F.col("doc_id") % 4
    whole = F.when(i == 0, F.concat(F.lit("---\n"), k, F.lit("\n---\n"), "text")).when(i == 1, F.concat(F.lit("---\r\n"), k, F.lit("\n---\r\n"), "text")).when(i == 2, F.concat(F.lit("---\n"), k, F.lit("\n---"))).otherwise(F.concat(F.lit("---\n"), "text"))
    d = _table(spark, sf, "documents").select("doc_id", whole.alias("whole"))
    block, body = T.frontmatter_split(F.col("whole"))
    return d.select("doc_id", block.alias("block"), body.alias("body"))


@query("SELECT doc_id, CASE WHEN lang < source THEN lang || ',' || source ELSE source || ',' || lang END AS tags FROM documents")
def tag_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" ##"), "source"), F.lit("# ").substr(1, 1), F.col("lang"), F.concat(F.col("lang"), F.lit("\t")), F.lit("  "), F.lit(None))
    return _table(spark, sf, "documents").select("doc_id", F.array_join(T.normal_tags(raw), ",").alias("tags"))


@query("""SELECT conv_id, turn, CASE WHEN contains(text, ':') OR contains(text, '#') OR contains(text, '"') OR contains(text, '''') THEN '"' || replace(text, '"', '\\"') || '"' ELSE text END AS scalar,
 left(text, 200) || CASE WHEN strlen(text) > 200 THEN '...' ELSE '' END AS preview FROM conversations""".replace("\\\\", "\\"))
def yaml_scalar_preview(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf, "conversations").select("conv_id", "turn", T.yaml_scalar(t).alias("scalar"), F.concat(F.left(t, F.lit(200)), F.when(F.octet_length(t) > 200, F.lit("...")).otherwise(F.lit(""))).alias("preview"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') = '7'""")
def events_props_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = scalar_text(F.col("props"), "k")
    return _table(spark, sf, "events").select("event_id", k.alias("k")).where("k = '7'")


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'schema_version' WHEN doc_id % 13 = 0 THEN 'plugin_id' WHEN doc_id % 17 = 0 THEN 'doc_id' WHEN doc_id % 19 = 0 THEN 'content_hash'
 WHEN doc_id % 23 = 0 THEN 'source_updated_at' WHEN doc_id % 29 = 0 THEN 'doc_type' WHEN doc_id % 31 = 0 THEN 'classification' END AS error FROM documents)
SELECT doc_id, error FROM e""")
def validate_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    d = corpus(spark, sf)
    i = lambda n: F.col("n") % n == 0
    d = d.withColumn("n", F.col("doc_id")).select(
        "n", F.when(i(11), 2).otherwise(1).alias("schema_version"), F.struct(F.when(i(13), F.lit("other")).otherwise(F.lit("tables")).alias("plugin_id")).alias("source"),
        F.struct(F.when(i(17), F.lit("  ")).otherwise(F.col("external_id")).alias("doc_id"), F.when(i(19), F.lit("sha256:xyz")).otherwise(T.content_hash(F.col("text"))).alias("content_hash"), F.when(i(23), F.lit("2024-01-01")).otherwise(F.col("source_updated_at")).alias("source_updated_at")).alias("document"),
        F.struct(F.when(i(29), F.lit("")).otherwise(F.col("doc_type")).alias("doc_type"), F.when(i(31), F.lit("secret")).otherwise(F.col("classification")).alias("classification")).alias("metadata"),
    )
    return d.select(F.col("n").alias("doc_id"), ingest.validation_error("tables").alias("error"))


# ---------------------------------------------------------------- keyword search

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), t AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS token FROM w) GROUP BY doc_id, token) SELECT t.doc_id, token, tf, CAST(len(ws) AS BIGINT) AS dl FROM t JOIN w ON t.doc_id = w.doc_id")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    p = R.postings(_table(spark, sf, "documents"), ["doc_id"], "text")
    return p.select("doc_id", "token", "tf", F.col("dl").cast("long").alias("dl"))


@query(f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS token FROM documents) GROUP BY token")
def df_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(_table(spark, sf, "documents"), ["doc_id"], "text").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"SELECT count(*) AS n, round(avg(len({_WORDS})), 6) AS avgdl FROM documents")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return R.corpus_stats(_table(spark, sf, "documents"), "text").select("n", F.round("avgdl", 6).alias("avgdl"))


def _ranked_sql(hits: str, n: int = 25) -> str:
    return f"SELECT doc_id, round(score, 4) AS score FROM {hits} ORDER BY {hits}.score DESC, doc_id LIMIT {n}"


@query(f"WITH {bm25_sql(['the'])} {_ranked_sql('hits')}")
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_keyword(spark, sf, "the"))


@query(f"WITH {bm25_sql(TERMS)} {_ranked_sql('hits')}")
def keyword_multi_term(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_keyword(spark, sf))


@query(f"WITH {bm25_sql(['qqxzzy'])} {_ranked_sql('hits')}")
def keyword_no_match(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_keyword(spark, sf, "qqxzzy"))


@query(f"WITH {bm25_sql(TERMS)} {_ranked_sql('hits', 125)}")
def keyword_from_postings(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    index = R.postings(docs, ["doc_id"], "text")
    return _top(R.bm25_from_index(index, R.corpus_stats(docs, "text"), R.document_frequencies(index), ["doc_id"], TERMS), N)


@query(rf"""WITH c AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, text FROM conversations), {bm25_sql(['the', 'of'], 'c')},
j AS (SELECT conv_id, count(*) AS n_hits, max(round(score, 4)) AS score FROM hits JOIN c ON hits.doc_id = c.doc_id GROUP BY conv_id)
SELECT conv_id, n_hits, score FROM j ORDER BY score DESC, conv_id LIMIT 20""")
def conversation_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations").withColumn("doc_id", F.col("conv_id") * 100000 + F.col("turn"))
    hits = R.bm25(rows, ["doc_id", "conv_id"], "text", "the of")
    return hits.groupBy("conv_id").agg(F.count("*").alias("n_hits"), F.max(R.rounded(F.col("score"))).alias("score")).orderBy(F.desc("score"), "conv_id").limit(20)


# ---------------------------------------------------------------- semantic and hybrid


def _query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return _table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def _semantic(spark: SparkSession, sf: str, metric: str = "l2") -> DataFrame:
    return R.semantic(_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), ["doc_id"], "embedding", _query_vector(spark, sf), metric)


_DIST = "q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), sem AS (SELECT vec_id AS doc_id, exp(-{d}) AS score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, qv), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS sq FROM embeddings, q))"
_L2, _SQ = _DIST.format(d="sqrt(sq)"), _DIST.format(d="sq")


@query(f"WITH {_L2} {_ranked_sql('sem', N)}")
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_semantic(spark, sf), N)


@query(f"WITH {_L2}, b AS (SELECT * FROM sem ORDER BY score DESC, doc_id LIMIT {N}) SELECT doc_id, round(score, 4) AS score FROM b WHERE score >= 0.3")
def semantic_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(_semantic(spark, sf), ["doc_id"], N).where(F.col("score") >= R.THRESHOLD).select("doc_id", R.rounded(F.col("score")).alias("score"))


@query(f"WITH {_SQ} {_ranked_sql('sem')}")
def semantic_sq(spark: SparkSession, sf: str) -> DataFrame:
    return _top(_semantic(spark, sf, "l2sq"))


_FUSED = f"""{bm25_sql(TERMS)}, {_L2},
ka AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM hits QUALIFY r <= {N}),
va AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM sem QUALIFY r <= {N}),
fused AS (SELECT coalesce(ka.doc_id, va.doc_id) AS doc_id, coalesce(1e0 / (60 + ka.r), 0) + coalesce(1e0 / (60 + va.r), 0) AS score, ka.r IS NULL OR va.r IS NULL AS one_sided FROM ka FULL JOIN va ON ka.doc_id = va.doc_id)"""


@query(f"WITH {_FUSED} {_ranked_sql('fused')}")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _top(R.fuse(_keyword(spark, sf), _semantic(spark, sf), ["doc_id"], N))


@query(f"WITH {_FUSED} SELECT count(*) AS n, CAST(count(*) FILTER (one_sided) AS BIGINT) AS one_sided FROM fused")
def hybrid_one_sided(spark: SparkSession, sf: str) -> DataFrame:
    a = R.ranked(_keyword(spark, sf), ["doc_id"], N).select("doc_id", F.lit(1).alias("a"))
    b = R.ranked(_semantic(spark, sf), ["doc_id"], N).select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_sided"))


_PROFILE = "CASE WHEN doc_id % 4 IN (0, 1) THEN 'local' ELSE 'cloud' END"


@query(f"WITH a AS (SELECT * FROM documents WHERE {_PROFILE} = 'local'), b AS (SELECT * FROM documents WHERE {_PROFILE} = 'cloud'), ra AS (WITH {bm25_sql(TERMS, 'a')} SELECT 'local' AS profile, * FROM hits ORDER BY score DESC, doc_id LIMIT {N}), rb AS (WITH {bm25_sql(TERMS, 'b')} SELECT 'cloud' AS profile, * FROM hits ORDER BY score DESC, doc_id LIMIT {N}) SELECT profile, doc_id, round(score, 4) AS score FROM (FROM ra UNION ALL FROM rb) ORDER BY round(score, 4) DESC, doc_id LIMIT 50")
def federated_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").withColumn("profile", F.when((F.col("doc_id") % 4).isin(0, 1), "local").otherwise("cloud"))
    arms = [R.top(R.bm25(docs.where(F.col("profile") == p), ["doc_id"], "text", QUERY), ["doc_id"], N).withColumn("profile", F.lit(p)) for p in ("local", "cloud")]
    return reduce(lambda a, b: a.unionByName(b), arms).select("profile", "doc_id", R.rounded(F.col("score")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query(f"WITH {bm25_sql(TERMS)} SELECT doc_id, round(score, 4) AS score, 'keyword' AS search_mode FROM hits ORDER BY hits.score DESC, doc_id LIMIT 25")
def keyword_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search whose embedder can't be reached: the arm of vectors is left out."""
    vector = R.query_vector(service("http://127.0.0.1:9", "m"), QUERY, R.Mode.HYBRID)
    keyword = _keyword(spark, sf)
    fused = keyword if vector is None else R.fuse(keyword, R.semantic(_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), ["doc_id"], "embedding", vector), ["doc_id"], N)
    return _top(fused).withColumn("search_mode", F.lit("keyword" if vector is None else "hybrid"))


# ---------------------------------------------------------------- filters and shapes


def _filtered(spark: SparkSession, sf: str, where: R.SearchFilter, n: int = N) -> DataFrame:
    docs = corpus_with_labels(spark, sf) if where.frontmatter else corpus(spark, sf).withColumn("frontmatter_json", F.lit("{}"))
    return R.attach(R.top(_keyword(spark, sf), ["doc_id"], n), docs.drop("text"), where).select("doc_id", R.rounded(F.col("score")).alias("score"))


def _filter_sql(where: str, n: int = N) -> str:
    return f"WITH {_CORPUS}, {bm25_sql(TERMS)}, best AS (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT {n}) SELECT corpus.doc_id, round(score, 4) AS score FROM best JOIN corpus ON best.doc_id = corpus.doc_id WHERE NOT deleted AND ({where})"


@query(_filter_sql("doc_type = 'book'"))
def filter_doc_type(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(doc_type="book"))


@query(_filter_sql("classification = 'internal'"))
def filter_classification(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(classification="internal"))


@query(_filter_sql("contains(external_id, 'en/') OR contains(external_id, 'src7')"))
def filter_path_in(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(path_includes=["en/", "src7"]))


@query(_filter_sql("NOT contains(external_id, 'src1') AND NOT contains(external_id, '5.md')"))
def filter_path_out(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(path_excludes=["src1", "5.md"]))


@query(_filter_sql("source_updated_at >= '2024-01-01T05:30:00Z'"))
def filter_since(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(since="2024-01-01T06:30:00+01:00"))


@query(_filter_sql("quality = 1 AND toxic = 0"))
def filter_frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(frontmatter={"quality": "1", "toxic": "0"}))


@query(_filter_sql("doc_type = 'note' AND classification IN ('public') AND contains(external_id, 'en/') AND NOT contains(external_id, 'src9') AND source_updated_at >= '2024-01-01T00:10:00Z'"))
def filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter("note", "public", ["en/"], ["src9"], "2024-01-01T00:10:00Z"))


@query(_filter_sql("classification = 'internal' AND doc_type = 'book'", 60))
def postfilter_underflow(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf, R.SearchFilter(doc_type="book", classification="internal"), 60)


def _chunk_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as chunks of conversations: doc_id is the conversation."""
    rows = _table(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 100000 + F.col("turn"))
    best = R.top(R.bm25(rows, ["key"], "text", "the of"), ["key"], N)
    return rows.join(F.broadcast(best), "key").select(F.col("conv_id").alias("doc_id"), "text", F.col("role").alias("file"), R.rounded(F.col("score")).alias("score"))


_CHUNK = f"c AS (SELECT conv_id * 100000 + turn AS doc_id, conv_id, role, text FROM conversations), {bm25_sql(['the', 'of'], 'c')}, best AS (SELECT * FROM hits ORDER BY score DESC, doc_id LIMIT {N}), ch AS (SELECT c.conv_id AS doc_id, c.text, c.role AS file, round(score, 4) AS score FROM best JOIN c ON best.doc_id = c.doc_id)"


@query(f"WITH {_CHUNK}, g AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS chunk_count, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, text) AS n FROM ch) SELECT doc_id, text, score, chunk_count FROM g WHERE n = 1 ORDER BY score DESC, doc_id LIMIT 10")
def group_by_doc(spark: SparkSession, sf: str) -> DataFrame:
    return R.document_results(_chunk_hits(spark, sf), 10).select("doc_id", "text", "score", "chunk_count")


@query(f"WITH {_CHUNK}, g AS (SELECT *, row_number() OVER (PARTITION BY file, text ORDER BY score DESC, doc_id) AS n FROM ch) SELECT doc_id, file, text, score FROM g WHERE n = 1 ORDER BY score DESC, doc_id, text LIMIT 30")
def chunk_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunk_results(_chunk_hits(spark, sf), 30).select("doc_id", "file", "text", "score")


@query(f"WITH {_CHUNK} SELECT 'chunk' AS shape, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'document', CAST(0 AS BIGINT)")
def limit_zero(spark: SparkSession, sf: str) -> DataFrame:
    hits = _chunk_hits(spark, sf)
    one = R.chunk_results(hits, 0).agg(F.count("*").alias("n")).select(F.lit("chunk").alias("shape"), "n")
    return one.unionByName(R.document_results(hits, 0).agg(F.count("*").alias("n")).select(F.lit("document").alias("shape"), "n"))


# ---------------------------------------------------------------- catalogue

_LIVE = f"WITH {_CORPUS}, live AS (SELECT * FROM corpus WHERE NOT deleted)"


@query(f"{_LIVE} SELECT tag, count(*) AS doc_count FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS tag FROM live) GROUP BY tag")
def browse_topics(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse_topics(corpus(spark, sf))


@query(f"{_LIVE} SELECT tag, count(*) AS doc_count FROM (SELECT doc_id, unnest(list_distinct([lang, source])) AS tag FROM live WHERE classification = 'public') GROUP BY tag")
def browse_topics_class(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.browse_topics(corpus(spark, sf), "public")


@query(f"{_LIVE} SELECT doc_type, count(*) AS n FROM live GROUP BY doc_type UNION ALL SELECT NULL, count(*) FROM live")
def counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts_by_type(corpus(spark, sf))


@query("SELECT count(*) AS n FROM documents")
def doc_count(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).agg(F.count("*").alias("n"))


# --- routing and reconciliation: state rows are derived from the documents


def _policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("restricted", "local"), ("confidential", "local"), ("public", "cloud")], "classification string, profile_id string")


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    d = corpus(spark, sf).withColumn("content_hash", T.content_hash(F.col("text"))).withColumn("markdown_path", F.col("external_id")).drop("text")
    return reconcile.route(d, _policy(spark), "default")


def _state(spark: SparkSession, sf: str) -> DataFrame:
    """What an earlier run left: most documents, some under another hash, path or profile, and rows of documents that are gone."""
    d = _table(spark, sf, "documents")
    i = lambda n, k: F.col("doc_id") % n == k
    profile = F.when(i(13, 5), "cloud").when((F.col("doc_id") % 4).isin(0, 1), "local").when(i(4, 3), "cloud").otherwise("default")
    path = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.when(i(17, 2), ".old").otherwise(".md")))
    return d.select(
        F.when(i(97, 1), F.col("doc_id") + 100000000).otherwise(F.col("doc_id")).alias("doc_id"), profile.alias("embedding_profile_id"), F.when(i(7, 3), "deleted").otherwise("indexed").alias("status"),
        F.when(i(11, 4), "sha256:old").otherwise(T.content_hash(F.col("text"))).alias("indexed_content_hash"), path.alias("indexed_markdown_path"), (F.col("doc_id") % 9).alias("chunk_count"),
    )


_ROUTED = f"""{_CORPUS}, routed AS (SELECT *, CASE classification WHEN 'restricted' THEN 'local' WHEN 'confidential' THEN 'local' WHEN 'public' THEN 'cloud' ELSE 'default' END AS profile, 'sha256:' || sha256(text) AS hash FROM corpus),
state AS (SELECT CASE WHEN doc_id % 97 = 1 THEN doc_id + 100000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 13 = 5 THEN 'cloud' WHEN doc_id % 4 IN (0, 1) THEN 'local' WHEN doc_id % 4 = 3 THEN 'cloud' ELSE 'default' END AS profile,
  CASE WHEN doc_id % 11 = 4 THEN 'sha256:old' ELSE 'sha256:' || sha256(text) END AS hash, lang || '/' || source || '/' || doc_id || CASE WHEN doc_id % 17 = 2 THEN '.old' ELSE '.md' END AS path, doc_id % 9 AS chunk_count FROM documents WHERE CASE WHEN doc_id % 7 = 3 THEN 'deleted' ELSE 'indexed' END = 'indexed'),
stale AS (SELECT s.doc_id, s.profile, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN r.deleted THEN 'deleted' WHEN r.profile <> s.profile THEN 'profile' WHEN s.path <> r.external_id THEN 'path' END AS reason, s.path FROM state s LEFT JOIN routed r ON s.doc_id = r.doc_id),
changed AS (SELECT r.doc_id, r.profile FROM routed r LEFT JOIN state s ON r.doc_id = s.doc_id AND r.profile = s.profile WHERE NOT r.deleted AND (s.doc_id IS NULL OR s.hash <> r.hash OR s.path <> r.external_id))"""


@query(f"WITH {_ROUTED} SELECT profile AS embedding_profile_id, count(*) AS n FROM routed GROUP BY profile")
def route_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).groupBy("embedding_profile_id").agg(F.count("*").alias("n"))


#: Customers as rules: each routes a class to the profile of their nation; nations are profiles, every sixth is missing.
_RULES = "p AS (SELECT DISTINCT ['restricted', 'confidential', 'internal', 'public'][c_custkey % 4 + 1] AS classification, 'p' || c_nationkey AS profile_id FROM customer), f AS (SELECT 'p' || n_nationkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'local' ELSE 'cloud' END AS locality FROM nation WHERE n_nationkey % 6 <> 5)"


@query(f"WITH {_RULES} SELECT classification, profile_id, CASE WHEN id IS NULL THEN 'unknown profile' ELSE 'must be local' END AS reason FROM p LEFT JOIN f ON profile_id = id WHERE id IS NULL OR (locality = 'cloud' AND classification IN ('restricted', 'confidential'))")
def routing_violation(spark: SparkSession, sf: str) -> DataFrame:
    policy = _table(spark, sf, "customer").select(F.element_at(F.array(*map(F.lit, T.CLASSIFICATIONS)), (F.col("c_custkey") % 4 + 1).cast("int")).alias("classification"), F.concat(F.lit("p"), "c_nationkey").alias("profile_id")).distinct()
    profiles = _table(spark, sf, "nation").where("n_nationkey % 6 <> 5").select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.when(F.col("n_regionkey") % 2 == 0, "local").otherwise("cloud").alias("locality"))
    return reconcile.routing_violations(policy, profiles)


@query(f"WITH {_ROUTED} SELECT doc_id, profile AS embedding_profile_id, reason, path AS delete_path FROM stale WHERE reason IS NOT NULL")
def stale_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.stale(_state(spark, sf), _routed(spark, sf))


@query(f"WITH {_ROUTED} SELECT doc_id, profile AS embedding_profile_id FROM changed")
def changed_docs(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.changed(_routed(spark, sf), _state(spark, sf)).select("doc_id", "embedding_profile_id")


@query(f"WITH {_ROUTED}, c AS (SELECT profile, count(*) AS n FROM changed GROUP BY profile), a AS (SELECT profile, count(*) AS n FROM routed WHERE NOT deleted GROUP BY profile) SELECT a.profile AS embedding_profile_id, coalesce(c.n, 0) AS indexed, a.n - coalesce(c.n, 0) AS skipped FROM a LEFT JOIN c ON a.profile = c.profile")
def index_plan_counts(spark: SparkSession, sf: str) -> DataFrame:
    routed = _routed(spark, sf)
    todo = reconcile.changed(routed, _state(spark, sf)).groupBy("embedding_profile_id").agg(F.count("*").alias("n"))
    live = routed.where("NOT deleted").groupBy("embedding_profile_id").agg(F.count("*").alias("a"))
    n = F.coalesce("n", F.lit(0))
    return live.join(todo, "embedding_profile_id", "left").select("embedding_profile_id", n.alias("indexed"), (F.col("a") - n).alias("skipped"))


@query(f"WITH {_ROUTED} SELECT r.doc_id, r.title, CAST(coalesce(s.chunk_count, 0) AS BIGINT) AS chunk_count, r.external_id AS file FROM routed r LEFT JOIN state s ON r.doc_id = s.doc_id AND r.profile = s.profile WHERE NOT r.deleted AND doc_type = 'book'")
def list_books(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_books(_routed(spark, sf), _state(spark, sf))


#: Suppliers as profiles, most of them with the meta of an index.
_METAS = "s AS (SELECT 's' || s_suppkey AS profile_id, 'm' || s_nationkey % 3 AS model, s_suppkey % 5 <> 0 AS has, 6 - CAST(s_suppkey % 4 = 1 AS INT) AS v, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN 'other' ELSE 'm' || s_nationkey % 3 END AS known FROM supplier), i AS (SELECT *, CASE WHEN NOT has THEN 'index meta missing' WHEN v <> 6 THEN 'index schema outdated' WHEN known IS NULL THEN 'embedding model missing' WHEN known <> model THEN 'embedding model mismatch' END AS issue FROM s)"


@query(f"WITH {_METAS} SELECT profile_id, issue IS NULL AS queryable, issue, CASE WHEN NOT has THEN 'not_indexed' WHEN v <> 6 THEN 'outdated(v' || v || ', need v6)' ELSE 'ready' END AS status FROM i")
def readiness(spark: SparkSession, sf: str) -> DataFrame:
    key, model = F.col("s_suppkey"), F.concat(F.lit("m"), (F.col("s_nationkey") % 3).cast("string"))
    known = _table(spark, sf, "supplier").select(F.concat(F.lit("s"), key).alias("id"), model.alias("model"), (6 - (key % 4 == 1).cast("int")).alias("schema_version"), F.when(key % 7 == 1, "other").when(key % 7 != 0, model).alias("embedding_model"), (key % 5 != 0).alias("has"))
    return reconcile.readiness(known.select("id", "model"), known.where("has").select(F.col("id").alias("profile_id"), "schema_version", "embedding_model"))


@query("SELECT 'c' || p_partkey AS component, CASE WHEN p_size % 10 = 0 THEN 'pending(missing -> v25)' WHEN p_size < 25 THEN 'pending(v' || p_size || ' -> v25)' ELSE 'ok' END AS status FROM part")
def migration_status(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as components at the version of their size."""
    found = _table(spark, sf, "part").select(F.concat(F.lit("c"), "p_partkey").alias("component"), F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("current"), F.lit(25).alias("target"))
    return reconcile.migration_status(found)


# --- ingest: a batch made of the documents, with doc_ids that repeat


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id") % 300).alias("doc_id"), T.content_hash(F.concat("lang", "source")).alias("content_hash"), (F.col("doc_id") % 6 == 5).alias("deleted"), F.concat(F.lit("p"), "doc_id").alias("markdown_path"))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents").groupBy((F.col("doc_id") % 450).alias("k")).agg(F.max(F.concat("lang", "source")).alias("t"))
    return d.select(F.concat(F.lit("d"), "k").alias("doc_id"), T.content_hash(F.col("t")).alias("content_hash"), (F.col("k") % 10 == 3).alias("deleted"), F.concat(F.lit("stored"), "k").alias("markdown_path"), F.lit("2023").alias("created_at"), F.lit("2023").alias("updated_at"))


_BATCH = """batch AS (SELECT doc_id AS seq, 'd' || doc_id % 300 AS doc_id, 'sha256:' || sha256(lang || source) AS hash, doc_id % 6 = 5 AS deleted, 'p' || doc_id AS path FROM documents),
stored AS (SELECT 'd' || k AS doc_id, 'sha256:' || sha256(max(t)) AS hash, k % 10 = 3 AS deleted, 'stored' || k AS path FROM (SELECT doc_id % 450 AS k, lang || source AS t FROM documents) GROUP BY k),
acted AS (SELECT b.*, row_number() OVER w AS nth, CASE WHEN row_number() OVER w = 1 THEN s.hash ELSE lag(b.hash) OVER w END AS before, CASE WHEN row_number() OVER w = 1 THEN coalesce(NOT s.deleted, false) ELSE NOT lag(b.deleted) OVER w END AS live
  FROM batch b LEFT JOIN stored s ON b.doc_id = s.doc_id WINDOW w AS (PARTITION BY b.doc_id ORDER BY seq)),
acts AS (SELECT *, CASE WHEN deleted THEN 'tombstone' WHEN coalesce(before = hash, false) AND live THEN 'unchanged' ELSE 'written' END AS action FROM acted)"""


@query(f"WITH {_BATCH} SELECT seq, doc_id, action FROM acts")
def ingest_actions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.actions(_batch(spark, sf), _stored(spark, sf)).select("seq", "doc_id", "action")


@query(f"WITH {_BATCH} SELECT count(*) AS processed, count(*) FILTER (action = 'written') AS written, count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'tombstone') AS tombstoned, count(*) FILTER (deleted AND live) AS deleted_files, count(*) FILTER (nth > 1) AS duplicate_doc_ids FROM acts")
def ingest_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.counters(ingest.actions(_batch(spark, sf), _stored(spark, sf)))


@query(f"WITH {_BATCH} SELECT doc_id, count(*) AS n FROM acts WHERE action = 'written' AND NOT live AND before = hash GROUP BY doc_id")
def tombstone_resurrect(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that came back, with the hash that they were deleted with: written anew each time."""
    own = Window.partitionBy("doc_id").orderBy("seq")
    acted = ingest.actions(_batch(spark, sf), _stored(spark, sf))
    stored = _stored(spark, sf).select(F.col("doc_id").alias("_d"), F.col("content_hash").alias("_h"), F.col("deleted").alias("_x"))
    rows = acted.join(stored, F.col("doc_id") == F.col("_d"), "left").withColumn("b", F.coalesce(F.lag("content_hash").over(own), F.when(F.col("nth") == 1, F.col("_h")))).withColumn("gone", F.coalesce(F.lag("deleted").over(own), F.when(F.col("nth") == 1, F.coalesce("_x", F.lit(True)))))
    return rows.where("action = 'written' AND gone AND b = content_hash").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_BATCH}, u AS (SELECT doc_id, -1 AS seq, hash, deleted, path, '2023' AS ts FROM stored UNION ALL SELECT doc_id, seq, hash, deleted, path, '2024' FROM batch), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS n, first_value(path) OVER (PARTITION BY doc_id ORDER BY seq) AS p, first_value(ts) OVER (PARTITION BY doc_id ORDER BY seq) AS c FROM u) SELECT doc_id, hash AS content_hash, deleted, p AS markdown_path, c AS created_at, ts AS updated_at FROM r WHERE n = 1")
def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merge(_stored(spark, sf), _batch(spark, sf), F.lit("2024"))


# ---------------------------------------------------------------- chunks


def _paragraphed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, of which every seventh has its sentences set apart by blank lines."""
    return _table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text")).alias("text"))


def _last(sep: str) -> str:
    lit = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)
    return f"(CASE WHEN instr(reverse(seg), reverse({lit})) > 0 THEN length(seg) - instr(reverse(seg), reverse({lit})) - {len(sep) - 1} ELSE -1 END)"


_MARKS = ["\n\n", ". ", ".\n", "? ", "!\n", "! ", "?\n"]
#: Characters of several bytes become one chr(1) and a chr(2) per further byte, so that offsets in characters are offsets in bytes.
_CHUNKS = f"""RECURSIVE d AS (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[\\x{{80}}-\\x{{7FF}}]', chr(1) || chr(2), 'g'), '[\\x{{800}}-\\x{{FFFF}}]', chr(1) || chr(2) || chr(2), 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', chr(1) || chr(2) || chr(2) || chr(2), 'g') AS m
  FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS t FROM documents) WHERE trim(t) <> ''),
step AS (
  SELECT doc_id, m, 0 AS ix, 0 AS start, CASE WHEN length(m) <= 3000 THEN length(m) ELSE -1 END AS stop FROM d
  UNION ALL
  SELECT doc_id, m, ix, start, stop FROM (
    SELECT doc_id, m, CASE WHEN stop = -1 THEN ix ELSE ix + 1 END AS ix, s0 AS start,
      CASE WHEN e0 >= length(m) THEN length(m) ELSE s0 + CASE {' '.join(f"WHEN {_last(x)} > 750 THEN {_last(x)} + {len(x)}" for x in _MARKS)} ELSE length(seg) END END AS stop
    FROM (SELECT *, substr(m, s0 + 1, e0 - s0) AS seg FROM (
      SELECT *, CASE WHEN s0 + 3000 >= length(m) THEN length(m) ELSE s0 + 3000 - CASE WHEN substr(m, s0 + 3001, 1) <> chr(2) THEN 0 WHEN substr(m, s0 + 3000, 1) <> chr(2) THEN 1 WHEN substr(m, s0 + 2999, 1) <> chr(2) THEN 2 ELSE 3 END END AS e0 FROM (
        SELECT doc_id, m, ix, stop, CASE WHEN stop = -1 THEN 0 ELSE s1 + CASE WHEN substr(m, s1 + 1, 1) <> chr(2) THEN 0 WHEN substr(m, s1 + 2, 1) <> chr(2) THEN 1 WHEN substr(m, s1 + 3, 1) <> chr(2) THEN 2 ELSE 3 END END AS s0
        FROM (SELECT *, greatest(start + 1, stop - 200) AS s1 FROM step WHERE stop = -1 OR stop < length(m)))))))
"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM step WHERE stop >= 0")
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges of chunks, before trimming."""
    return chunking.chunk_documents(_paragraphed(spark, sf)).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query(f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks FROM step WHERE stop >= 0 GROUP BY doc_id")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_paragraphed(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


_CHUNKED = "chunked AS (SELECT doc_id * 100000 + ix AS doc_id, substr(t, 1 + length(replace(substr(m, 1, start), chr(2), '')), length(replace(substr(m, 1, stop), chr(2), '')) - length(replace(substr(m, 1, start), chr(2), ''))) AS text FROM step JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS t FROM documents) USING (doc_id) WHERE stop >= 0)"


@query(f"WITH {_CHUNKS}, {_CHUNKED}, {bm25_sql(TERMS, 'chunked')} SELECT doc_id // 100000 AS doc_id, CAST(doc_id % 100000 AS INTEGER) AS chunk_ix, round(score, 4) AS score FROM hits ORDER BY hits.score DESC, hits.doc_id LIMIT 25")
def chunk_keyword(spark: SparkSession, sf: str) -> DataFrame:
    parts = chunking.chunk_documents(_paragraphed(spark, sf))
    hits = R.bm25(parts, ["doc_id", "chunk_ix"], "chunk_text", QUERY)
    return R.top(hits, ["doc_id", "chunk_ix"], 25).select("doc_id", "chunk_ix", R.rounded(F.col("score")).alias("score"))


@query()
def keyword_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """With the index's full analyser: folded, without stop words, stemmed."""
    return _top(R.bm25(_table(spark, sf, "documents"), ["doc_id"], "text", "ering edings éreau", analysis.analysed))


# ---------------------------------------------------------------- folders and lookups


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("f"), "p_partkey").alias("name"), F.when(F.col("p_partkey") > 3, F.floor(F.col("p_partkey") / 2)).cast("long").alias("parent_id"))


_TREE = "f AS (SELECT p_partkey AS id, 'f' || p_partkey AS name, CASE WHEN p_partkey > 3 THEN p_partkey // 2 END AS parent_id FROM part), t AS (SELECT f.id, '/' || f.name AS path FROM f LEFT JOIN f p ON f.parent_id = p.id WHERE p.id IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name FROM t JOIN f ON f.parent_id = t.id)"


@query(f"WITH RECURSIVE {_TREE} SELECT id, path FROM t")
def folder_paths(spark: SparkSession, sf: str) -> DataFrame:
    return folders.folder_paths(_folders(spark, sf))


@query(f"WITH RECURSIVE {_TREE}, b AS (SELECT CAST(3 AS BIGINT) AS id UNION ALL SELECT f.id FROM b JOIN f ON f.parent_id = b.id) SELECT id FROM b")
def folder_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return folders.subtree(_folders(spark, sf), 3)


@query(f"WITH RECURSIVE {_TREE} SELECT id FROM t WHERE lower(path) = '/f2/f4/f9'")
def folder_find(spark: SparkSession, sf: str) -> DataFrame:
    return folders.find_by_path(_folders(spark, sf), "/F2/f4/F9")


@query("""SELECT n.n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'inline ' || n_name WHEN r_regionkey IS NOT NULL AND n_nationkey % 7 <> 0 THEN r_name ELSE 'Unknown' END AS status_name,
 CASE WHEN n_nationkey % 3 = 0 THEN '(unfiled)' ELSE '/' || r_name END AS folder_path FROM nation n LEFT JOIN region r ON n_regionkey = r_regionkey""")
def lookup_names(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation")
    key = F.col("n_nationkey")
    ref = lambda i, name: F.struct(i.cast("long").alias("id"), name.alias("name"))
    none = F.lit(None).cast("string")
    cases = n.select(
        key.alias("id"), ref(F.when(key % 7 != 0, F.col("n_regionkey")), F.when(key % 5 == 0, F.concat(F.lit("inline "), "n_name"))).alias("status"), ref(F.lit(None), none).alias("priority"),
        ref(F.when(key % 3 != 0, F.col("n_regionkey")), none).alias("folder"),
    )
    names = _table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return testcases.named(cases, names, names, names.select("id", F.concat(F.lit("/"), "name").alias("path"))).select("id", "status_name", "folder_path")


# ---------------------------------------------------------------- evaluation by labels of the vectors


def _judged(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """The k nearest of the vectors whose id is divisible by 100, with their relevance (the same label) and n_rel, all that are relevant.

    The relevant are counted by label, not in pairs; each shard of rows gives a query's k
    best alone, so that no pair is ever a row.
    """
    e = _table(spark, sf, "embeddings")
    counts = e.groupBy(F.col("label").cast("long").alias("ql")).agg((F.count("*") - 1).alias("n_rel"))
    found = nearest.nearest(e, F.col("vec_id") % 100 == 0, k).join(counts, "ql", "left")
    return found.select("query", "n_rel", "vec_id", (F.col("label") == F.col("ql")).cast("int").alias("rel"), "d", "rank")


_EVAL = "p AS (SELECT q.vec_id AS query, e.vec_id, CAST(e.label = q.label AS INT) AS rel, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))) AS d FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), j AS (SELECT *, sum(rel) OVER (PARTITION BY query) AS n_rel, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM p QUALIFY rank <= 10)"


@query(f"WITH {_EVAL} SELECT query, round(sum(rel) / CAST(any_value(n_rel) AS DOUBLE), 6) AS recall FROM j GROUP BY query")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).groupBy("query").agg(F.round(F.sum("rel") / F.first("n_rel"), 6).alias("recall"))


@query(f"WITH {_EVAL} SELECT round(avg(rr), 6) AS mrr FROM (SELECT query, coalesce(max(1e0 / rank) FILTER (rel = 1), 0) AS rr FROM j GROUP BY query)")
def mrr(spark: SparkSession, sf: str) -> DataFrame:
    first = _judged(spark, sf).groupBy("query").agg(F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return first.agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query(f"WITH {_EVAL}, g AS (SELECT query, sum(rel / log2(rank + 1)) AS dcg, CAST(least(any_value(n_rel), 10) AS BIGINT) AS n FROM j GROUP BY query) SELECT round(avg(dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM g")
def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    g = _judged(spark, sf).groupBy("query").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.least(F.first("n_rel"), F.lit(10)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return g.agg(F.round(F.avg(F.col("dcg") / ideal), 6).alias("ndcg"))


# ---------------------------------------------------------------- rendering (checked in the tests)


@query(rf"""SELECT n_nationkey, '# x' || chr(10) || '```plantuml' || chr(10) || 'actor ' || n_name || chr(10) || n_name || ' --> ' || r_name || ' : is in' || chr(10) || '```' || chr(10) || chr(10) || '{diagrams.OPEN}' || chr(10) || '{diagrams.TITLE}' || chr(10)
 || 'Entities: ' || array_to_string(list_sort([n_name, split_part(r_name, ' ', 1)]), ', ') || chr(10) || 'Relations:' || chr(10) || '- ' || n_name || ' --> ' || split_part(r_name, ' ', 1) || ': is in' || chr(10) || '{diagrams.CLOSE}' || chr(10) AS markdown FROM nation JOIN region ON n_regionkey = r_regionkey""")
def diagram_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").alias("n").join(F.broadcast(_table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    source = F.concat(F.lit("# x\n```plantuml\nactor "), "n_name", F.lit("\n"), "n_name", F.lit(" --> "), "r_name", F.lit(" : is in\n```\n"))
    return n.select("n_nationkey", diagrams.enrich_column(source).alias("markdown"))


_RENDERED = (
    "---\nkey: {k}\nname: {n}\nproject: P\nfolder: (unfiled)\nstatus: Unknown\npriority: Unknown\nowner: \nlabels: [{b}]\ncreated_on: \nupdated_on: \n---\n\n# {k}: {n}\n\n## Objective\n\n{t}\n\n## Test Steps\n"
    "\n### Step 1 (Index 1)\n\n**Description**\n{n}\n\n**Expected Result**\n**{b}**\n\n**Custom Fields**\n- `size`: {z}\n\n### Step 2 (Index 2)\n\n**Description**\n{t}\n\n**Expected Result**\n**{b}**\n\n**Custom Fields**\n- `size`: {z}\n"
)


@query(f"""SELECT 'P-' || p_partkey AS key, 'P-' || p_partkey || ': ' || p_name AS title,
 replace(replace(replace(replace(replace(replace('{_RENDERED.replace(chr(10), "~")}', '~', chr(10)), '{{k}}', 'P-' || p_partkey), '{{n}}', p_name), '{{b}}', p_brand), '{{t}}', p_type), '{{z}}', CAST(p_size AS VARCHAR)) AS markdown FROM part""")
def render_testcase(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part")
    none = F.lit(None).cast("string")
    ref = F.struct(F.lit(None).cast("long").alias("id"), none.alias("name"))
    step = lambda i, t: F.struct(F.lit(i).cast("long").alias("index"), t.alias("description"), none.alias("test_data"), F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")).alias("expected_result"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("custom_fields"))
    cases = p.select(
        F.concat(F.lit("P-"), "p_partkey").alias("key"), F.col("p_name").alias("name"), ref.alias("status"), ref.alias("priority"), ref.alias("folder"), none.alias("owner"), F.concat(F.lit("<p>"), "p_type", F.lit("</p>")).alias("objective"), none.alias("precondition"),
        F.array("p_brand").alias("labels"), F.array(step(2, F.col("p_type")), step(1, F.col("p_name"))).alias("steps"), none.alias("script_text"), F.lit(False).alias("has_script"), F.lit(None).cast("array<struct<issue_key:string,url:string>>").alias("links"), none.alias("created_on"), none.alias("updated_on"),
    )
    empty = spark.createDataFrame([], "id long, name string")
    return testcases.render(testcases.named(cases, empty, empty, spark.createDataFrame([], "id long, path string")), "P").select("key", "title", "markdown")


def _registered() -> None:
    """Modules that register more queries here."""
    from . import queries_indexed  # noqa: F401


def queries() -> dict:
    _registered()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_SQL)
