"""Text summaries of UML diagrams in markdown, so that their content can be searched: column expressions.

A diagram is an array of trimmed lines.  Each line is matched once against patterns, for an
alias, a declared name and a relation; a second pass replaces ends by what the
aliases declared up to their line stand for.  Markdown is cut at its diagram fences by one pattern, and put
together again with the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- fixed values -------------------------------------------------------------
#: Arrows in the order in which they are tried on a line.
ARROWS = ("<-->", "--|>", "<->", "-->", "..>", "-|>", "->", "<--", ".>", "<-")
KEYWORDS = ("participant", "actor", "boundary", "control", "entity", "database", "component", "interface", "class", "object", "usecase")
FENCES = ("plantuml", "puml")
MOST_RELATIONS = 50
OPEN, CLOSE, TITLE = "<!-- diagram-summary:start -->", "<!-- diagram-summary:end -->", "[Diagram summary]"
# -------------------------------------------------------------------------------

#: Patterns know all of Unicode's white space.
_U = "(?U)"
_FIRST, _LAST = _U + r"^\s*(\S+)", _U + r"(\S+)\s*$"
_BLANK = r"[^\S\n]*"
_FENCED = rf"{_U}(?ms)^{_BLANK}```(?:{'|'.join(FENCES)}){_BLANK}$\n?(.*?)(?:^{_BLANK}```{_BLANK}$|\z)"
_MARKED = rf"{_U}(?ms)^{_BLANK}\Q{OPEN}\E{_BLANK}$\n?.*?(?:^{_BLANK}\Q{CLOSE}\E{_BLANK}$\n?|\z)"
_STRAY = rf"{_U}(?m)^{_BLANK}\Q{CLOSE}\E{_BLANK}$\n?"


def _word(text: Column, pattern: str) -> Column:
    """The first or last word, without one pair of quotes of each kind; null if there is none."""
    word = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, pattern, 1), '^"|"$', ""), "^'|'$", "")
    return F.when(word != "", word)


def _after(text: Column, mark: str) -> Column:
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def _alias(line: Column) -> Column:
    """struct<key, name> of ``NAME as KEY``, or null."""
    name, key = _word(F.substring_index(line, " as ", 1), _LAST), _word(_after(line, " as "), _FIRST)
    return F.when(F.contains(line, F.lit(" as ")) & name.isNotNull() & key.isNotNull(), F.struct(key.alias("key"), name.alias("name")))


def _declared(line: Column) -> Column:
    return F.when(F.lower(F.regexp_extract(line, _FIRST, 1)).isin(*KEYWORDS), _word(F.regexp_extract(line, _U + r"^\S+\s+(\S+)", 1), _FIRST))


def _relation(line: Column) -> Column:
    """struct<from, arrow, to, label> by the first arrow that has a word on either side, or null."""

    def by(arrow: str) -> Column:
        rest = _after(line, arrow)
        a, b = _word(F.substring_index(line, arrow, 1), _LAST), _word(F.substring_index(rest, ":", 1), _FIRST)
        label = strip(F.when(F.contains(rest, F.lit(":")), _after(rest, ":")).otherwise(""))
        return F.when(F.contains(line, F.lit(arrow)) & a.isNotNull() & b.isNotNull(), F.struct(a.alias("from"), F.lit(arrow).alias("arrow"), b.alias("to"), label.alias("label")))

    return F.coalesce(*map(by, ARROWS))


def diagram_column(source: Column) -> Column:
    """struct<entities, relations> of a diagram's source: names in order, relations as they come."""
    lines = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), "\n", -1), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("'")))
    read = F.transform(lines, lambda x, i: F.struct(i.alias("at"), _alias(x).alias("alias"), _declared(x).alias("declared"), _relation(x).alias("relation")))

    def resolved(rows: Column) -> Column:
        aliases = F.filter(F.transform(rows, lambda r: F.struct(r["at"].alias("at"), r["alias"]["key"].alias("key"), r["alias"]["name"].alias("name"))), lambda a: a["key"].isNotNull())
        meant = lambda word, at: F.coalesce(F.try_element_at(F.filter(aliases, lambda a: (a["key"] == word) & (a["at"] <= at)), F.lit(-1))["name"], word)
        tied = F.transform(
            F.filter(rows, lambda r: r["relation"].isNotNull()),
            lambda r: F.struct(meant(r["relation"]["from"], r["at"]).alias("from"), r["relation"]["arrow"].alias("arrow"), meant(r["relation"]["to"], r["at"]).alias("to"), r["relation"]["label"].alias("label")),
        )

        def put(ties: Column) -> Column:
            named = F.concat(F.transform(aliases, lambda a: a["name"]), F.filter(F.transform(rows, lambda r: r["declared"]), lambda d: d.isNotNull()), F.transform(ties, lambda t: t["from"]), F.transform(ties, lambda t: t["to"]))
            text = lambda t: F.concat(t["from"], F.lit(" "), t["arrow"], F.lit(" "), t["to"], F.when(t["label"] != "", F.concat(F.lit(": "), t["label"])).otherwise(""))
            return F.struct(F.array_sort(F.array_distinct(named)).alias("entities"), F.transform(ties, text).alias("relations"))

        return F.transform(F.array(tied), put)[0]

    return F.transform(F.array(read), resolved)[0]


def _summary(source: Column) -> Column:
    """What follows a diagram's fence."""

    def told(d: Column) -> Column:
        entities = F.when(F.size(d["entities"]) > 0, F.concat(F.lit("\nEntities: "), F.array_join(d["entities"], ", ")))
        relations = F.when(F.size(d["relations"]) > 0, F.concat(F.lit("\nRelations:\n- "), F.array_join(F.slice(d["relations"], 1, MOST_RELATIONS), "\n- ")))
        whole = F.concat(F.lit(f"\n\n{OPEN}\n{TITLE}"), F.coalesce(entities, F.lit("")), F.coalesce(relations, F.lit("")), F.lit(f"\n{CLOSE}\n"))
        return F.when((F.size(d["entities"]) > 0) | (F.size(d["relations"]) > 0), whole).otherwise("")

    return F.transform(F.array(diagram_column(source)), told)[0]


def enrich_column(markdown: Column) -> Column:
    """Summaries after each diagram block, replacing earlier ones; the text ends in one line feed."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(markdown, r"\r(?=\n|\z)", ""), _MARKED, ""), _STRAY, "")

    def joined(text: Column) -> Column:
        sources = F.regexp_extract_all(text, F.lit(_FENCED), F.lit(1))
        blocks = F.regexp_extract_all(text, F.lit(_FENCED), F.lit(0))
        between = F.split(text, _FENCED, -1)
        # a block at the very end of the text, never closed, keeps its line feeds before the summary
        told = F.zip_with(blocks, sources, lambda b, s: F.concat(F.regexp_replace(b, r"\n\z", ""), _summary(s), F.when(F.endswith(b, F.lit("\n")), "\n").otherwise("")))
        return F.array_join(F.zip_with(between, told, lambda t, b: F.concat(t, F.coalesce(b, F.lit("")))), "")

    body = F.when(F.size(F.regexp_extract_all(plain, F.lit(_FENCED), F.lit(0))) > 0, F.transform(F.array(plain), joined)[0]).otherwise(plain)
    return F.concat(F.regexp_replace(body, _U + r"\s+\z", ""), F.lit("\n"))
