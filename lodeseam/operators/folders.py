"""Folder trees: full paths, subtrees and lookup by path, by pointer doubling.

Every folder holds a link to an ancestor and the names on the way.  A round of
self-joins doubles the links' lengths, so that a tree of any depth needs about
log2(depth) rounds; a round that shortens the list of open links by nothing has only
cycles left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _doubled(folders: DataFrame, start: Column, join: Column) -> DataFrame:
    """id, up (null: the way ends at a root), way: every folder's farthest known ancestor; ``join`` makes one way of far and near."""
    spark = folders.sparkSession
    known = folders.select(F.col("id").alias("_p"))
    links = folders.join(known, F.col("parent_id") == F.col("_p"), "left").select("id", F.col("_p").alias("up"), start.alias("way"))
    open_before = None
    while True:
        links = _cut(spark, links)
        still = links.where("up IS NOT NULL").count()
        if still == 0 or still == open_before:
            return links
        open_before = still
        far = links.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("way").alias("_way"))
        links = links.join(far, F.col("up") == F.col("_id"), "left").select("id", F.when(F.col("up").isNotNull(), F.col("_up")).alias("up"), F.when(F.col("up").isNull(), F.col("way")).otherwise(join).alias("way"))


def _cut(spark, df: DataFrame) -> DataFrame:
    """Lineage is cut in the shared folder where the session names one; otherwise rows are only cached by the plan."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint() if spark.sparkContext.getCheckpointDir() else df.persist()


def folder_paths(folders: DataFrame) -> DataFrame:
    """id, path (``/a/b``) of each folder (id, name, parent_id), however deep.

    A folder whose parent is unknown is a root; one on or below a cycle is a root of its own name.
    """
    own = F.concat(F.lit("/"), "name")
    found = _doubled(folders, own, F.concat(F.col("_way"), F.col("way"))).where("up IS NULL").select("id", F.col("way").alias("path"))
    rest = folders.join(found.select("id"), "id", "left_anti").select("id", own.alias("path"))
    return found.unionByName(rest)


def subtree(folders: DataFrame, root: int) -> DataFrame:
    """id of the folder and of all below it, however deep; an unknown id is its own subtree.

    The folder's own parent is cut off, so that a cycle through it ends there.
    """
    spark = folders.sparkSession
    cut_off = folders.withColumn("parent_id", F.when(F.col("id") != int(root), F.col("parent_id")))
    # a way holds the least information needed: whether the root is on it
    links = _doubled(cut_off, F.col("id") == int(root), F.col("way") | F.coalesce("_way", F.lit(False)))
    below = links.where("way").select("id")
    return below.unionByName(spark.range(1).select(F.lit(int(root)).cast("long").alias("id"))).distinct()


def find_by_path(folders: DataFrame, path: str) -> DataFrame:
    """id of the folder at a path, whatever its case."""
    return folder_paths(folders).where(F.lower("path") == path.lower()).select("id")
