"""Filesystem connector: a folder of text and office files as envelopes."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.diagrams import enrich_column
from ..functions.frontmatter import parse_frontmatter
from ..functions.text import content_hash, default_title

PLUGIN = "filesystem"
TEXT_EXTENSIONS = (".md", ".markdown", ".txt")
PDF, PANDOC, SLIDES = (".pdf",), (".epub", ".docx"), (".pptx",)
CONVERTED = PDF + PANDOC + SLIDES


def glob_regex(pattern: str) -> str | None:
    """A glob (``*``, ``?``, ``**``, ``[..]``, ``{a,b}``) as an anchored regular expression, or null if it is not one."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                return None
            inner = pattern[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", j + 1
            continue
        if c == "{":
            braces += 1
        elif c == "}":
            braces -= 1
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if braces else ","}.get(c) or re.escape(c)
        i += 1
    return None if braces else f"^{out}$"


def excluded(rel_path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches the path or a folder above it; patterns that are no globs are ignored."""
    out = F.lit(False)
    parts = F.split(rel_path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    for regex in filter(None, map(glob_regex, patterns)):
        out = out | _any_matches(above, regex)
    return out


def _any_matches(paths: Column, regex: str) -> Column:
    return F.exists(paths, lambda p: p.rlike(regex))


def canonical_root(spark: SparkSession, root: str) -> str:
    """One spelling of a folder, whichever way it is written: without scheme for local files, ``.``, ``..`` and links resolved."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    text = full.toString()
    return os.path.realpath(full.toUri().getPath()) if text.startswith("file:") else text.rstrip("/")


def skipped(spark: SparkSession, root: str, extensions: tuple[str, ...] = TEXT_EXTENSIONS, exclude: list[str] = ()) -> DataFrame:
    """rel_path, reason of files that give no envelope though their kind is wanted."""
    rows = discover(spark, root, extensions, exclude)
    reason = F.when(F.col("ext").isin(*CONVERTED), F.when(_converted(F.col("ext"), F.col("content")).isNull(), F.lit("no converter reads it"))).when(~F.is_valid_utf8(F.col("content").cast("string")), F.lit("not UTF-8"))
    return rows.select("rel_path", reason.alias("reason")).where("reason IS NOT NULL").orderBy("rel_path")


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...], exclude: list[str] = ()) -> DataFrame:
    """rel_path, ext, modified, content of the files under a folder, read by Spark (any store it knows)."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        raise FileNotFoundError(root)
    prefix = fs.resolvePath(base).toString().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    rel = F.substr(plain(F.col("path")), F.length(plain(F.lit(prefix))) + 1)
    rows = files.select(rel.alias("rel_path"), F.lower(F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1)).alias("ext"), F.col("modificationTime").alias("modified"), "content")
    return rows.where(F.col("ext").isin(*(e.lower() for e in extensions)) & ~excluded(F.col("rel_path"), list(exclude)))


def convert_file(ext: str, data: bytes) -> str | None:
    """Markdown of an office file by an installed converter, or null."""
    recipes = {
        ".pdf": [["docling", "--to", "md", "--output", "{dir}", "{file}"]],
        ".epub": [["pandoc", "-t", "gfm", "{file}"]],
        ".docx": [["pandoc", "-t", "gfm", "{file}"]],
        ".pptx": [["markitdown", "{file}"], ["pandoc", "-t", "gfm", "{file}"]],
    }
    with tempfile.TemporaryDirectory() as folder:
        file = Path(folder, f"in{ext}")
        file.write_bytes(data)
        for recipe in recipes.get(ext, []):
            if shutil.which(recipe[0]):
                done = subprocess.run([a.format(dir=folder, file=file) for a in recipe], capture_output=True, text=True, timeout=600)
                text = Path(folder, "in.md").read_text() if done.returncode == 0 and Path(folder, "in.md").exists() else done.stdout
                if done.returncode == 0 and text.strip():
                    return text
    return None


def _converted(ext: Column, content: Column) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for exts, contents in parts:
            yield pd.Series([convert_file(e, bytes(c)) for e, c in zip(exts, contents, strict=True)], dtype=object)

    return run(ext, content)


def envelopes(spark: SparkSession, root: str, classification: str = "internal", doc_type: str = "note", extensions: tuple[str, ...] = TEXT_EXTENSIONS, exclude: list[str] = (), enrich: bool = True) -> DataFrame:
    """Envelopes (schemas.ENVELOPE and seq) of the folder's files.

    Every file is a document of its own, so that seq, which orders rows of one
    document, is 0.  Files that are not UTF-8, or that no installed converter reads,
    are left out; ``skipped`` lists them.
    """
    files = discover(spark, root, extensions, exclude)
    root = canonical_root(spark, root)
    source_id = F.substring(F.sha2(F.lit(root), 256), 1, 12)
    office = [e for e in extensions if e in CONVERTED]
    raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    text = F.when(F.col("ext").isin(*office), _converted(F.col("ext"), F.col("content"))).otherwise(raw) if office else raw
    rows = parse_frontmatter(files.withColumn("_text", text).where("_text IS NOT NULL").drop("content"), "_text")
    body = enrich_column(F.col("body")) if enrich else F.col("body")
    rows = rows.withColumn("markdown", body)
    stem = F.regexp_replace(F.element_at(F.split("rel_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    when = F.date_format(F.coalesce("modified", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    instance = F.concat_ws(":", F.lit(PLUGIN), source_id)
    out = rows.select(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit(PLUGIN).alias("plugin_id"), instance.alias("connector_instance"), F.col("rel_path").alias("external_id"), F.concat(F.lit("file://"), F.lit(root.rstrip("/") + "/"), F.col("rel_path")).alias("uri")).alias("source"),
        F.struct(F.concat_ws(":", F.lit(PLUGIN), source_id, F.col("rel_path")).alias("doc_id"), default_title(stem).alias("title"), F.col("markdown"), content_hash(F.col("markdown")).alias("content_hash"), when.alias("source_updated_at"), F.lit(False).alias("deleted")).alias("document"),
        F.struct(F.lit(doc_type).alias("doc_type"), F.lit(classification).alias("classification"), F.col("tags"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("array<string>").alias("acl_tags"), F.col("frontmatter_json")).alias("metadata"),
        F.lit(0).cast("long").alias("seq"),
    )
    return out


def import_document(spark: SparkSession, path: str, markdown: str | None = None) -> DataFrame:
    """The envelope of one book (PDF or EPUB), converted unless its markdown is given."""
    file = Path(path)
    text = markdown if markdown is not None else convert_file(file.suffix.lower(), file.read_bytes())
    if text is None:
        raise ValueError(f"no installed converter reads {path}")
    row = spark.range(1).select(F.lit(str(file)).alias("path"), F.lit(file.stem).alias("stem"), F.lit(text).alias("markdown"))
    return row.select(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit("cli_import").alias("plugin_id"), F.lit("cli_import").alias("connector_instance"), F.col("path").alias("external_id"), F.concat(F.lit("file://"), "path").alias("uri")).alias("source"),
        F.struct(F.concat(F.lit("cli_import:"), F.sha2("path", 256)).alias("doc_id"), F.col("stem").alias("title"), "markdown", content_hash(F.col("markdown")).alias("content_hash"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("source_updated_at"), F.lit(False).alias("deleted")).alias("document"),
        F.struct(F.lit("book").alias("doc_type"), F.lit("internal").alias("classification"), F.lit(None).cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("language"), F.lit(None).cast("array<string>").alias("acl_tags"), F.lit(None).cast("string").alias("frontmatter_json")).alias("metadata"),
        F.lit(0).cast("long").alias("seq"),
    )
