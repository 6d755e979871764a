"""Chat formatting of reply trees, in DataFrame operations only.

A forest of messages (tree, node, parent, role, text, score) becomes one
training text per chosen branch:

1. Iterative self-joins on ancestor links, doubling the distance each time,
   give every node its depth and the summed score of its path to the root; a
   tree of depth d takes about log2(d) joins over rows of ids.
2. Leaves are the ends of branches.  Branches of a tree are ranked by their
   summed score (ties: smaller leaf id) and the best ``branches`` are kept
   (``None``: all).
3. The same links, walked from the longest jump down, enumerate each chosen
   root-to-leaf path; texts are joined only then.
4. Turns are escaped, marked and concatenated; loss spans are offsets in code
   points of the assistant texts inside the result.

Template of a turn: ``### role``, a newline, the text, ``</turn>``, a newline.
Escaping is reversible: a backslash becomes ``\\b``, then ``### `` becomes
``\\h`` and ``</turn>`` becomes ``\\e`` (in roles also a newline ``\\n``), so no
control string occurs inside an escaped text.

Defined results for odd input: null role, text: empty; null score: 0; a parent
that is null, unknown or the node itself makes a root; of rows that repeat
(tree, node) the smallest (parent, role, text) counts; a row with null node id
is on no path; nodes on or below a cycle have no root and thus no path; a null
tree id is a tree of its own.  Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

HEAD, END = "### ", "</turn>"
_SWAPS = ((HEAD, "\\h"), (END, "\\e"))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for plain, coded in _SWAPS + ((("\n", "\\n"),) if role else ()):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, coded in (*_SWAPS, ("\n", "\\n")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def branch_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, node, depth, branch_rank, branch_score) of each chosen root-to-leaf path.

    nodes: tree, node, parent, score; (tree, node) unique, node not null.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_p"))
    links = (
        nodes.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
        .join(known, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("parent") == F.col("_p")), "left")
        .select("tree", "node", F.col("_p").alias("up"), "total", F.lit(1).cast("long").alias("depth"))
    )
    #: jumps[k]: nodes that have an ancestor 2**k links up; state: every node's farthest known ancestor and what lies before it
    state, jumps, open_before = cut(links), [], None
    while True:
        open_rows = state.where(F.col("up").isNotNull())
        still = open_rows.count()
        if still == 0 or still == open_before:
            break
        open_before = still
        jumps.append(open_rows.select("tree", "node", "up"))
        far = state.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("total").alias("_s"), F.col("depth").alias("_d"))
        moved = open_rows.join(far, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("up") == F.col("_n"))).select(
            "tree", "node", F.col("_up").alias("up"), (F.col("total") + F.col("_s")).alias("total"), (F.col("depth") + F.col("_d")).alias("depth")
        )
        state = cut(state.where(F.col("up").isNull()).unionByName(moved))
    parents = links.where(F.col("up").isNotNull()).select(F.col("tree").alias("_t"), F.col("up").alias("_u")).distinct()
    leaves = state.where(F.col("up").isNull()).join(parents, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_u")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(order))
    if branches is not None:
        leaves = leaves.where(F.col("branch_rank") <= branches)
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", "branch_rank", F.col("total").alias("branch_score"))
    for jump in reversed(jumps):
        jump = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "up")
        path = path.join(jump, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left").select(
            "tree", "leaf", "branch_rank", "branch_score", F.explode(F.when(F.col("up").isNull(), F.array("node")).otherwise(F.array("node", "up"))).alias("node")
        )
    depth = state.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "depth")
    return path.join(depth, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).drop("_t", "_n")


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """One row per chosen branch: tree, leaf, branch_rank, branch_score, formatted, loss_spans.

    messages: tree, node, parent, role, text and perhaps score.  loss_spans
    holds (start, stop) code-point offsets of assistant texts in ``formatted``.
    """
    score = F.col("score") if "score" in messages.columns else F.lit(0.0)
    rows = (
        messages.where(F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), score.cast("double").alias("score"))).alias("m"))
        .select("tree", "node", "m.*")
    )
    path = branch_paths(rows.select("tree", "node", "parent", "score"), branches)
    texts = rows.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    turns = path.join(texts, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    head = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit("\n"))
    turns = turns.select("tree", "leaf", "branch_rank", "branch_score", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END) + 1))
    along = Window.partitionBy("tree", "leaf").orderBy("depth")
    turns = turns.withColumn("at", F.sum("size").over(along) - F.col("size"))
    piece = F.struct(
        "depth",
        F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
        F.when(F.col("role") == "assistant", F.struct((F.col("at") + F.length("head")).alias("start"), (F.col("at") + F.length("head") + F.length("body")).alias("stop"))).alias("span"),
    )
    grouped = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return grouped.select(
        "tree", "leaf", "branch_rank", "branch_score",
        F.array_join(F.col("p.turn"), "").alias("formatted"),
        F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text``, both from the formatted text alone and its spans."""
    cut_up = F.split(F.col("formatted"), f"{END}\n", -1)

    def turn(x: Column) -> Column:
        at = F.locate("\n", x)
        return F.struct(
            unescape(F.substr(x, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))).alias("role"),
            unescape(F.substr(x, at + 1)).alias("text"),
        )

    turns = F.transform(F.slice(cut_up, F.lit(1), F.size(cut_up) - 1), turn)
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text as reply trees: each row answers the one before it by (turn, role, text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = rows.withColumn("node", at.cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


PROBE = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role, :probe AS text FROM VALUES (0L), (1L) AS v(t)", args={"probe": PROBE})
    out = read_back(format_trees(conversation_messages(rows.unionByName(extra))))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\h'), '</turn>', '\e') AS et,
         replace(replace(replace(replace(role, '\', '\b'), '### ', '\h'), '</turn>', '\e'), chr(10), '\n') AS er FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(er) + length(et) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
