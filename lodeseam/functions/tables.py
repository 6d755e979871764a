"""Table functions for SQL: they take any table, keep its columns and add their own.

    SELECT * FROM chunks(TABLE(SELECT doc_id, text FROM documents), 'text')
    SELECT * FROM frontmatter(TABLE(notes) PARTITION BY (doc_id), 'text')

The columns of a result are found when a query is analysed, from those of the table that it
is given.  A table without PARTITION BY is worked on as it is dealt, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import chunking
from .frontmatter import parse_block

_CHUNK = [StructField("chunk_ix", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("chunk_text", StringType())]
_FRONT = [StructField("body", StringType()), StructField("tags", ArrayType(StringType())), StructField("frontmatter_json", StringType())]


def _analysed(table: AnalyzeArgument, column: AnalyzeArgument, added: list[StructField]) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(...)")
    if not column.isConstantExpression or not isinstance(column.value, str):
        raise ValueError("the column's name is a constant string")
    if column.value not in table.dataType.names:
        raise ValueError(f"the table has no column '{column.value}'; it has {', '.join(table.dataType.names)}")
    if clash := sorted({f.name for f in added} & set(table.dataType.names)):
        raise ValueError(f"the table has columns that the function adds: {', '.join(clash)}")
    return AnalyzeResult(StructType([*table.dataType.fields, *added]))


class Chunks:
    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        return _analysed(table, column, _CHUNK)

    def eval(self, row: Row, column: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        text = row[column]
        for i, (start, end, part) in enumerate(chunking.chunks(text, size, overlap) if text is not None else ()):
            yield (*row, i, start, end, part)


class Frontmatter:
    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        return _analysed(table, column, _FRONT)

    def eval(self, row: Row, column: str) -> Iterator[tuple]:
        text = row[column]
        block, body = split_text(text) if text is not None else (None, text)
        ok, tags, whole = parse_block(block) if block is not None else (False, None, None)
        yield (*row, body if ok else text, tags, whole)


def split_text(text: str) -> tuple[str | None, str]:
    """(block, body) of a text, as ``frontmatter_split`` has them."""
    opened = next((m for m in ("---\r\n", "---\n") if text.startswith(m)), None)
    if opened is None:
        return None, text
    rest = text[len(opened) :]
    for mark in ("\n---\n", "\n---\r\n"):
        if mark in rest:
            block, _, body = rest.partition(mark)
            return block, body
    return (rest.removesuffix("\n---"), "") if rest.endswith("\n---") else (None, text)


def register(spark: SparkSession) -> None:
    """Makes ``chunks`` and ``frontmatter`` known to SQL."""
    spark.udtf.register("chunks", udtf(Chunks))
    spark.udtf.register("frontmatter", udtf(Frontmatter))
