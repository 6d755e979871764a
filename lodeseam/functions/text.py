"""Text functions as column expressions: hashes, paths, normalisation, HTML to markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
CLASSIFICATIONS = ("restricted", "confidential", "internal", "public")
DEFAULT_GENERATION = "gen_default"
#: Ordered rewrite rules of the HTML converter: pattern, replacement.
HTML_RULES = (
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<(strong|b)>", "**"),
    (r"(?i)</(strong|b)>", "**"),
    (r"(?i)<(em|i)>", "_"),
    (r"(?i)</(em|i)>", "_"),
    (r"""(?is)<a\s[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>""", "[$2]($1)"),
    (r"(?i)<li[^>]*>", "- "),
    (r"(?i)</li>", "\n"),
    (r"(?i)<p[^>]*>", ""),
    (r"(?i)</p>", "\n\n"),
    (r"<[^>]+>", ""),
)
#: Entities, decoded in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "))
# -------------------------------------------------------------------------------

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Trims Unicode white space, which the built-in trim does not."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def safe_component(text: Column, most: int) -> Column:
    """A path component: lower-case ASCII letters and digits, ``-_.``; separators become single dashes; never empty."""
    out = F.regexp_replace(text, r"(?U)[\s/\\]", "-")
    out = F.regexp_replace(F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^a-z0-9_.\-]", "")
    out = F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-", "")
    out = F.regexp_replace(F.substring(out, 1, most), "^-+|-+$", "")
    return F.when(out == "", F.lit("unnamed")).otherwise(out)


def canonical_path(classification: Column, plugin: Column, connector: Column, doc_id: Column) -> Column:
    slug = safe_component(connector, 32)
    short = short_hash(connector, 12)
    folder = F.when(slug == "unnamed", short).otherwise(F.concat_ws("-", slug, short))
    return F.concat_ws("/", safe_component(classification, 24), safe_component(plugin, 48), folder, F.concat(short_hash(doc_id, 24), F.lit(".md")))


def normal_classification(text: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(strip(text)), F.lit("")), F.lit("internal"))


def normal_generation(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare.rlike(r"^[A-Za-z0-9._-]+$"), bare).otherwise(F.lit(DEFAULT_GENERATION))


def html_to_md(html: Column) -> Column:
    """Simple HTML as markdown, by an ordered chain of rewrites (all built-in, so that it stays in codegen)."""
    out = reduce(lambda t, rule: F.regexp_replace(t, *rule), HTML_RULES, html)
    out = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, out)
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normal_tags(tags: Column) -> Column:
    """Trimmed, without leading ``#``, sorted and distinct; null if none is left."""
    bare = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.regexp_replace(strip(t), "^#+", ""))
    out = F.array_sort(F.array_distinct(F.filter(bare, lambda t: t != "")))
    return F.when(F.size(out) > 0, out)


def default_title(stem: Column) -> Column:
    return F.when(stem.isNull(), F.lit("untitled")).otherwise(strip(F.translate(stem, "_-", "  ")))


def yaml_scalar(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.rlike("[:#\"']"), quoted).otherwise(text)


def instant(text: Column) -> Column:
    """A strict RFC 3339 time as a timestamp, else null (a plain cast accepts far more)."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.upper(text)))


def frontmatter_split(text: Column) -> tuple[Column, Column]:
    """(YAML block or null, body): a block opens with a first line ``---`` and closes with the first such line, by preference of ``\\n`` endings."""
    opened = F.when(F.startswith(text, F.lit("---\r\n")), F.lit(6)).when(F.startswith(text, F.lit("---\n")), F.lit(5))
    rest = F.substr(text, opened)
    lf, crlf = F.locate("\n---\n", rest), F.locate("\n---\r\n", rest)
    at_end = F.endswith(rest, F.lit("\n---"))
    block = F.when(lf > 0, F.substr(rest, F.lit(1), lf - 1)).when(crlf > 0, F.substr(rest, F.lit(1), crlf - 1)).when(at_end, F.substr(rest, F.lit(1), F.length(rest) - 4))
    body = F.when(lf > 0, F.substr(rest, lf + 5)).when(crlf > 0, F.substr(rest, crlf + 6)).when(at_end, F.lit(""))
    block = F.when(opened.isNotNull(), block)
    return block, F.when(block.isNotNull(), body).otherwise(text)
