"""Index reconciliation: which documents to index again, and which vectors to remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_classification

# --- fixed values -------------------------------------------------------------
INDEX_SCHEMA, METADATA_FORMAT, CANONICAL, PIPELINE, SERVING, MANIFEST = 6, 1, 1, 1, 1, 4
LOCAL_ONLY = ("restricted", "confidential")
# -------------------------------------------------------------------------------


def route(documents: DataFrame, policy: DataFrame, default_profile: str) -> DataFrame:
    """``documents`` with embedding_profile_id: the policy's for the normalised classification, else the default.

    policy: classification, profile_id; a row per class, which is broadcast.
    """
    p = policy.select(F.col("classification").alias("_class"), F.col("profile_id").alias("_profile"))
    joined = documents.withColumn("_norm", normal_classification(F.col("classification"))).join(F.broadcast(p), F.col("_norm") == F.col("_class"), "left")
    return joined.withColumn("embedding_profile_id", F.coalesce("_profile", F.lit(default_profile))).drop("_norm", "_class", "_profile")


def routing_violations(policy: DataFrame, profiles: DataFrame) -> DataFrame:
    """classification, profile_id, reason: unknown profiles, and cloud profiles for classes that must stay local."""
    joined = policy.join(profiles.select(F.col("id").alias("profile_id"), "locality"), "profile_id", "left")
    reason = F.when(F.col("locality").isNull(), F.lit("unknown profile")).when(F.col("classification").isin(*LOCAL_ONLY) & (F.col("locality") != "local"), F.lit("must be local"))
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select("classification", "profile_id", "reason")


def changed(documents: DataFrame, state: DataFrame, force: bool | Column = False) -> DataFrame:
    """Live routed documents to index: forced, never indexed, or with another hash or path than indexed."""
    s = state.where("status = 'indexed'").select(F.col("doc_id").alias("_doc"), F.col("embedding_profile_id").alias("_profile"), F.col("indexed_content_hash").alias("_hash"), F.col("indexed_markdown_path").alias("_path"))
    rows = documents.where("NOT coalesce(deleted, false)").join(s, (F.col("doc_id") == F.col("_doc")) & (F.col("embedding_profile_id") == F.col("_profile")), "left")
    force = F.lit(force) if isinstance(force, bool) else force
    same = F.col("_doc").isNotNull() & F.col("_hash").eqNullSafe(F.col("content_hash")) & F.col("_path").eqNullSafe(F.col("markdown_path"))
    return rows.where(force | ~same).drop("_doc", "_profile", "_hash", "_path")


def stale(state: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, embedding_profile_id, reason, delete_path of indexed rows to remove; documents are routed.

    Profiles that no live document uses any more are reconciled as well.
    """
    d = documents.select(F.col("doc_id").alias("_doc"), F.col("deleted").alias("_deleted"), F.col("embedding_profile_id").alias("_profile"), F.col("markdown_path").alias("_path"))
    rows = state.where("status = 'indexed'").join(d, F.col("doc_id") == F.col("_doc"), "left")
    reason = (
        F.when(F.col("_doc").isNull(), F.lit("missing"))
        .when(F.coalesce("_deleted", F.lit(False)), F.lit("deleted"))
        .when(F.col("_profile") != F.col("embedding_profile_id"), F.lit("profile"))
        .when(F.col("indexed_markdown_path").isNotNull() & ~F.col("indexed_markdown_path").eqNullSafe(F.col("_path")), F.lit("path"))
    )
    path = F.coalesce("indexed_markdown_path", "_path")
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull() & (F.coalesce(path, F.lit("")) != "")).select("doc_id", "embedding_profile_id", "reason", path.alias("delete_path"))


def readiness(profiles: DataFrame, meta: DataFrame) -> DataFrame:
    """profile_id, queryable, issue, status. meta: profile_id, schema_version, embedding_model (an index's meta)."""
    joined = profiles.select(F.col("id").alias("profile_id"), "model").join(meta.withColumn("_has", F.lit(True)), "profile_id", "left")
    v, m = F.col("schema_version"), F.col("embedding_model")
    issue = (
        F.when(F.col("_has").isNull(), F.lit("index meta missing"))
        .when(~F.coalesce(v == INDEX_SCHEMA, F.lit(False)), F.lit("index schema outdated"))
        .when(m.isNull(), F.lit("embedding model missing"))
        .when(m != F.col("model"), F.lit("embedding model mismatch"))
    )
    status = (
        F.when(F.col("_has").isNull(), F.lit("not_indexed"))
        .when(~F.coalesce(v == INDEX_SCHEMA, F.lit(False)), F.concat(F.lit("outdated(v"), F.coalesce(v, F.lit(0)).cast("string"), F.lit(f", need v{INDEX_SCHEMA})")))
        .otherwise(F.lit("ready"))
    )
    return joined.select("profile_id", issue.isNull().alias("queryable"), issue.alias("issue"), status.alias("status"))


def migration_status(found: DataFrame) -> DataFrame:
    """component, status from component, current (null: missing), target."""
    c, t = F.col("current"), F.col("target")
    pending = lambda a: F.concat(F.lit("pending("), a, F.lit(" -> v"), t.cast("string"), F.lit(")"))
    return found.select("component", F.when(c.isNull(), pending(F.lit("missing"))).when(c < t, pending(F.concat(F.lit("v"), c.cast("string")))).otherwise(F.lit("ok")).alias("status"))
