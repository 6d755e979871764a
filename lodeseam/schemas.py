"""Explicit schemas of the store; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _s(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


#: Exchange record between connectors and the store.
ENVELOPE = StructType(
    [
        StructField("schema_version", IntegerType()),
        StructField("source", StructType(_s("plugin_id", "connector_instance", "external_id", "uri"))),
        StructField("document", StructType([*_s("doc_id", "title", "markdown", "content_hash", "source_updated_at"), StructField("deleted", BooleanType())])),
        StructField("metadata", StructType([*_s("doc_type", "classification"), StructField("tags", ArrayType(StringType())), StructField("language", StringType()), StructField("acl_tags", ArrayType(StringType())), StructField("frontmatter_json", StringType())])),
    ]
)

#: One row per doc_id; the canonical text is a column.
DOCUMENTS = StructType(
    [
        *_s("doc_id", "plugin_id", "connector_instance", "external_id", "uri", "title", "doc_type", "classification", "content_hash", "source_updated_at", "markdown_path", "tags_json", "language", "acl_tags_json", "frontmatter_json", "markdown"),
        StructField("deleted", BooleanType()),
        *_s("created_at", "updated_at"),
    ]
)

BLOBS = StructType([*_s("doc_id", "path"), StructField("size_bytes", LongType()), *_s("checksum")])

INDEX_STATE = StructType([*_s("doc_id", "generation_id", "embedding_profile_id", "status"), StructField("chunk_count", LongType()), *_s("indexed_content_hash", "indexed_markdown_path", "embedded_at", "updated_at")])

CHUNKS = StructType([*_s("doc_id"), StructField("chunk_ix", IntegerType()), *_s("text"), StructField("vector", ArrayType(FloatType()))])

#: Partial counts of tags, and sketches of distinct values per bucket of documents.
TOPICS = StructType([*_s("classification", "tag"), StructField("n", LongType())])
SKETCHES = StructType([*_s("part", "what"), StructField("sketch", BinaryType())])

PROFILES = StructType(_s("id", "provider", "endpoint", "model", "locality"))

FOLDERS = StructType([StructField("id", LongType()), *_s("name"), StructField("parent_id", LongType())])

_REF = StructType([StructField("id", LongType()), *_s("name")])
STEPS = ArrayType(StructType([StructField("index", LongType()), *_s("description", "test_data", "expected_result"), StructField("custom_fields", MapType(StringType(), StringType()))]))
LINKS = ArrayType(StructType(_s("issue_key", "url")))
TEST_CASES = StructType(
    [
        StructField("id", LongType()), *_s("key", "name"), StructField("folder", _REF), StructField("status", _REF), StructField("priority", _REF),
        *_s("owner", "objective", "precondition"), StructField("labels", ArrayType(StringType())), StructField("steps", STEPS), StructField("script_text", StringType()),
        StructField("has_script", BooleanType()), StructField("links", LINKS), *_s("created_on", "updated_on"),
    ]
)


def with_missing(df, schema: StructType, defaults: dict | None = None):
    """``df`` in the shape of ``schema``: absent columns are added with a default (null), extra ones dropped."""
    from pyspark.sql import functions as F

    defaults = defaults or {}
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields))
