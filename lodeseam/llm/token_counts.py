"""Edit-aware token counts: segment trees of pre-tokens.

A document is cut into leaves of whole pre-tokens, of about ``LEAF`` characters.
A cut is safe where the two characters beside it alone make a boundary of pre-tokens:
before white space that follows anything else, and where letters, numbers and other
characters meet, but for an apostrophe before a letter.  No pre-token reaches across,
and what lies beyond can't change one on this side.  So a leaf is long only where a
single pre-token is (with white space before it), as in a script without spaces.
A binary tree over the leaves holds the characters and tokens of every subtree.

An edit (start, deleted, inserted; in characters of the text as it then is) finds
its leaves by walking down the character sums, re-encodes these leaves and, only
while a boundary is no longer safe, their neighbours, and adds the differences
along the paths to the root.  A leaf that outgrows ``8 * LEAF`` is cut again and its
tree rebuilt from the leaves' known counts; nothing else is re-encoded.

The tree is stored as two arrays per document (leaf characters and tokens), so
that later edits need no other tokens encoded again.

Odd input: null text: empty; an edit beyond the text is moved to its end, and it
deletes at most what is there; null start: 0; null deleted: 0; null inserted:
empty; null edits: none; edits of a document apply in order of seq, ties by
(start, deleted, inserted); edits of unknown or null doc_ids have no effect; rows
that repeat a doc_id are edited alike; a single pre-token, however long, is one leaf.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

LEAF = 384
#: Places between two characters that no pre-token reaches across: of letters (L), numbers (N), white space (W) and others.
_SAFE = regex.compile(
    r"""(?V1)(?<=\P{White_Space})(?=\p{White_Space})
    |(?<=\p{L})(?=[^\p{L}\p{White_Space}])
    |(?<=\p{N})(?=[^\p{N}\p{White_Space}])
    |(?<=[^\p{L}\p{N}\p{White_Space}'])(?=\p{L})
    |(?<=[^\p{L}\p{N}\p{White_Space}])(?=\p{N})""",
    regex.VERBOSE,
)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_ENCODINGS: dict = {}


def encoding(path: str):
    """The worker's encoding of a rank file, kept from task to task."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def safe(left: str, right: str) -> bool:
    """Whether a cut between two texts is safe; never at the end of an empty one."""
    return bool(left and right) and _SAFE.match(left[-1] + right[0], 1) is not None


def leaves(text: str) -> list[str]:
    out, at = [], 0
    while True:
        m = _SAFE.search(text, at + LEAF)
        if m is None:
            return [*out, text[at:]]
        out.append(text[at : m.start()])
        at = m.start()


class CountTree:
    """Leaves of a text and sums of characters and tokens over a heap-shaped binary tree."""

    def __init__(self, parts: list[str], tokens: list[int] | None, encode) -> None:
        self.encode, self.encoded = encode, 0
        self._build(parts, tokens if tokens is not None else [self._count(p) for p in parts])

    def _count(self, part: str) -> int:
        self.encoded += len(part)
        return len(self.encode(part)) if part else 0

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.parts, self.size = parts, 1 << max(0, len(parts) - 1).bit_length()
        blank = [0] * self.size
        self.chars = blank + [len(p) for p in parts] + [0] * (self.size - len(parts))
        self.tokens = blank + tokens + [0] * (self.size - len(parts))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def leaf_tokens(self) -> list[int]:
        return self.tokens[self.size : self.size + len(self.parts)]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset in it) of a character; the last leaf with text for the end."""
        i = 1
        while i < self.size:
            i *= 2
            if at >= self.chars[i] and self.chars[i + 1]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def _set(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        i = leaf + self.size
        more, many = len(part) - self.chars[i], tokens - self.tokens[i]
        while i:
            self.chars[i] += more
            self.tokens[i] += many
            i //= 2

    def _beside(self, leaf: int, step: int) -> int | None:
        """The next leaf with text on one side."""
        leaf += step
        while 0 <= leaf < len(self.parts):
            if self.parts[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, start: int, deleted: int, inserted: str) -> None:
        start = min(max(0, start), self.chars[1])
        deleted = min(max(0, deleted), self.chars[1] - start)
        first, offset = self._find(start)
        last, end = self._find(start + deleted) if deleted else (first, offset)
        region = self.parts[first][:offset] + inserted + self.parts[last][end:]
        while (left := self._beside(first, -1)) is not None and not safe(self.parts[left], region):
            first, region = left, self.parts[left] + region
        while (right := self._beside(last, 1)) is not None and not safe(region, self.parts[right]):
            last, region = right, region + self.parts[right]
        for i in range(first + 1, last + 1):
            if self.parts[i]:
                self._set(i, "", 0)
        if len(region) > 8 * LEAF and len(pieces := leaves(region)) > 1:
            known = self.leaf_tokens()
            self._build(self.parts[:first] + pieces + self.parts[last + 1 :], known[:first] + [self._count(p) for p in pieces] + known[last + 1 :])
        else:
            self._set(first, region, self._count(region))


_STATE = "leaf_chars array<int>, leaf_tokens array<int>"
_EDIT = "struct<start:long,deleted:long,inserted:string>"
_FIGURES = [("n_tokens_before", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("n_edits", pa.int64()), ("n_chars_encoded", pa.int64())]


def count_tokens(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, text, edits, the text's tree after its edits, and token counts before and after.

    docs: doc_id, text; ``edits`` (array of start, deleted, inserted, in order) if
    there are any; leaf_chars and leaf_tokens if a tree of the text is known.
    n_chars_encoded counts the characters that the edits caused to be encoded.
    """
    path = ranks or default_ranks()
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    columns.append((F.col("edits") if "edits" in docs.columns else F.array()).cast(f"array<{_EDIT}>").alias("edits"))
    columns += [(F.col(c) if c in docs.columns else F.lit(None)).cast("array<int>").alias(c) for c in ("leaf_chars", "leaf_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for whole in batches:
            for batch in slices(whole, "text"):
                texts, chars, tokens, figures = [], [], [], []
                for text, edits, sizes, known in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", "leaf_chars", "leaf_tokens")), strict=True):
                    if sizes is not None and known is not None and sum(sizes) == len(text):
                        ends = [0]
                        for s in sizes:
                            ends.append(ends[-1] + s)
                        tree = CountTree([text[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], list(known), encode)
                    else:
                        tree = CountTree(leaves(text), None, encode)
                    before, tree.encoded = tree.total, 0
                    for e in edits or ():
                        if e is not None:
                            tree.edit(e["start"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    texts.append(tree.text)
                    chars.append([len(p) for p in tree.parts])
                    tokens.append(tree.leaf_tokens())
                    figures.append((before, tree.total, tree.chars[1], len(edits or ()), tree.encoded))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), *(pa.array(c, t) for c, (_, t) in zip(zip(*figures, strict=True), _FIGURES, strict=True))],
                    ["doc_id", "text", "leaf_chars", "leaf_tokens", *(n for n, _ in _FIGURES)],
                )

    return docs.select(*columns).mapInArrow(run, f"doc_id long, text string, {_STATE}, " + ", ".join(f"{n} long" for n, _ in _FIGURES))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with an ``edits`` column from a log of (doc_id, seq, start, deleted, inserted)."""
    log = edits.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "deleted", "inserted"))).alias("_e"))
    joined = docs.drop("edits").join(log, F.col("doc_id") == F.col("_d"), "left").drop("_d")
    return joined.withColumn("edits", F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["deleted"].alias("deleted"), e["inserted"].alias("inserted")))).drop("_e")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens before and after four edits: a word at the front, one replaced in the middle, a cut at a third, a line at the end."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    edit = lambda start, deleted, inserted: F.struct(start.cast("long").alias("start"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(F.lit(0), 0, "Draft "), edit(F.floor(n / 2), 9, " changed it's "), edit(F.floor(n / 3), 40, ""), edit(n * 2, 0, "\nEnd of the text."))
    out = count_tokens(docs.select("doc_id", "text").withColumn("edits", edits))
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_chars_encoded", F.size("leaf_chars").cast("long").alias("n_leaves"))
