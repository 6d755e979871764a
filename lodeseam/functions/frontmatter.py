"""Frontmatter: YAML blocks at the head of markdown texts, as tags and a JSON object."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import frontmatter_split


class _Loader(yaml.SafeLoader):
    """YAML scalars as YAML 1.2 core has them: no dates, no yes/no, no sexagesimals."""


_Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in rules if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float", "tag:yaml.org,2002:value")]
    for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()
}
for _tag, _pattern, _first in (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*|0x[0-9a-fA-F]+|0o[0-7]+)$", "-+0123456789"),
    ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", "-+0123456789."),
):
    import re as _re

    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", _re.compile(_pattern), list(_first))


def _int(loader, node) -> int:
    text = loader.construct_scalar(node)
    return int(text, 0) if text.lstrip("+-").startswith(("0x", "0o")) else int(text)


_Loader.add_constructor("tag:yaml.org,2002:int", _int)


def parse_block(block: str) -> tuple[bool, list[str] | None, str | None]:
    """(valid, tags, JSON of the top-level mapping with sorted keys) of a YAML block."""
    try:
        value = yaml.load(block, _Loader)  # noqa: S506
    except (yaml.YAMLError, ValueError, RecursionError):
        return False, None, None
    if not isinstance(value, dict):
        return True, None, None
    named = value.get("tags")
    tags = None
    if isinstance(named, list):
        tags = sorted({t for v in named if isinstance(v, str) and (t := v.strip().lstrip("#"))}) or None
    try:
        whole = json.dumps({k if isinstance(k, str) else json.dumps(k): v for k, v in value.items()}, sort_keys=True, ensure_ascii=False, default=str)
    except (TypeError, ValueError):
        whole = None
    return True, tags, whole


_PARSED = "struct<ok:boolean,tags:array<string>,json:string>"


def parse_frontmatter(docs: DataFrame, text: str) -> DataFrame:
    """Adds body, tags (array, null if none), frontmatter_json (null if there is no mapping)."""

    @F.pandas_udf(_PARSED)
    def parse(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in blocks:
            yield pd.DataFrame([dict(zip(("ok", "tags", "json"), (False, None, None) if b is None else parse_block(b), strict=True)) for b in s], columns=["ok", "tags", "json"])

    block, body = frontmatter_split(F.col(text))
    rows = docs.withColumn("_block", block).withColumn("_body", body).withColumn("_yaml", parse("_block"))
    good = F.coalesce(F.col("_yaml.ok"), F.lit(False))
    return rows.select(*docs.columns, F.when(good, F.col("_body")).otherwise(F.col(text)).alias("body"), F.when(good, F.col("_yaml.tags")).alias("tags"), F.when(good, F.col("_yaml.json")).alias("frontmatter_json"))


def scalar_text(json_text: Column, key: str) -> Column:
    """The text of a top-level string, number or boolean; null for anything else.

    Keys may hold dots, so that no JSON path is used.  Text comes from the plain
    map (which keeps 1.0 as written), the kind of value from the variant map.
    """
    kind = F.schema_of_variant(F.try_element_at(F.from_json(json_text, "map<string,variant>"), F.lit(key)))
    scalar = kind.rlike(r"^(STRING|BOOLEAN|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return F.when(scalar, F.try_element_at(F.from_json(json_text, "map<string,string>"), F.lit(key)))
