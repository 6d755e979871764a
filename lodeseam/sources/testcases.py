"""Test-case connector: a REST source of test cases, rendered as markdown in one plan."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import content_hash, html_to_md, yaml_scalar
from ..operators.folders import find_by_path, folder_paths, subtree

PLUGIN = "testcases"
PAGE, TIMEOUT = 50, 30
#: Tasks that requests for single cases are dealt to.
REQUESTS = 32


def pages(fetch: Callable[[str], dict], base: str, path: str) -> Iterator[dict]:
    """Values of all pages: follows ``next`` (relative ones from the base) until ``isLast``; no mark means last."""
    url = f"{base.rstrip('/')}/{path.lstrip('/')}"
    while url:
        page = fetch(url)
        yield from page.get("values") or []
        following = None if page.get("isLast", True) else page.get("next")
        url = following if following is None or "://" in following else f"{base.rstrip('/')}/{following.lstrip('/')}"


def _fetch(url: str, token: str) -> dict:
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}", "Accept": "application/json"})
    with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:  # noqa: S310
        return json.load(reply)


class RestSource(DataSource):
    """``spark.read.format("rest_pages")`` with options base, token, paths (``;`` between them): path, value (JSON).

    Option ``whole``: a path is one object rather than pages of values.  Option
    ``lenient``: a path that can't be fetched has no values.  A filter on ``path`` reaches the
    source (with ``spark.sql.python.filterPushdown.enabled``): other paths are not requested.

    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("value", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        # Spark refuses a reader that takes filters where the session doesn't push them
        return _PushedReader(self.options) if self.options.get("pushed") == "true" else _RestReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _RestStream(self.options)


class _RestReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base, self.token, self.paths = options["base"], options.get("token", ""), options["paths"].split(";")
        self.whole, self.lenient = options.get("whole") == "true", options.get("lenient") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = lambda url: _fetch(url, self.token)
        try:
            values = iter([fetch(f"{self.base.rstrip('/')}/{partition.value.lstrip('/')}")]) if self.whole else pages(fetch, self.base, partition.value)
            for value in values:
                yield partition.value, json.dumps(value)
        except OSError:
            if not self.lenient:
                raise


class _PushedReader(_RestReader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("path",) else set(f.value) if isinstance(f, In) and f.attribute == ("path",) else None
            if wanted is None:
                yield f
            else:
                self.paths = [p for p in self.paths if p in wanted]


class _Page(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        super().__init__((path, first, count))


class _RestStream(DataSourceStreamReader):
    """Values of listings that only grow at their end.

    Offsets count the values of each path that were given; a batch is fetched page by page, each page by a task of its own.

    What a batch holds follows from its offsets alone, so that a batch that is run again after a
    restart holds the same values, none twice and none left out.
    """

    def __init__(self, options: dict) -> None:
        self.base, self.token, self.paths = options["base"], options.get("token", ""), options["paths"].split(";")

    def _page(self, path: str, first: int, count: int) -> dict:
        return _fetch(f"{self.base.rstrip('/')}/{path.lstrip('/')}{'&' if '?' in path else '?'}startAt={first}&maxResults={count}", self.token)

    def initialOffset(self) -> dict:
        return {p: 0 for p in self.paths}

    def latestOffset(self) -> dict:
        """How many values each path has now: as the service counts them, else by its pages."""
        out = {}
        for path in self.paths:
            page = self._page(path, 0, 1)
            if page.get("total") is not None:
                out[path] = int(page["total"])
                continue
            at = 0
            while True:
                page = self._page(path, at, PAGE)
                at += len(page.get("values") or [])
                if page.get("isLast", True) or not page.get("values"):
                    break
            out[path] = at
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(p, at, min(PAGE, end[p] - at)) for p in self.paths for at in range(start.get(p, 0), end.get(p, 0), PAGE)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, first, count = partition.value
        at, stop = first, first + count
        while at < stop:  # a service may give fewer than asked for
            values = (self._page(path, at, stop - at).get("values") or [])[: stop - at]
            if not values:
                raise RuntimeError(f"{path}: values {at} to {stop} are gone")
            for value in values:
                yield path, at, json.dumps(value)
                at += 1


class RestStreamSource(RestSource):
    @classmethod
    def name(cls) -> str:
        return "rest_values"

    def schema(self) -> StructType:
        return StructType([StructField("path", StringType()), StructField("at", LongType()), StructField("value", StringType())])


def stream_values(spark: SparkSession, base: str, token: str, paths: list[str]) -> DataFrame:
    """path, at, value of growing listings, as a stream."""
    spark.dataSource.register(RestStreamSource)
    return spark.readStream.format("rest_values").option("base", base).option("token", token).option("paths", ";".join(paths)).load()


def stream_cases(spark: SparkSession, base: str, token: str, projects: list[str]) -> DataFrame:
    """path, at and the fields of the test cases of projects, as a stream: each case once."""
    values = stream_values(spark, base, token, [f"testcases?projectKey={urllib.parse.quote(p)}" for p in projects])
    return parse_cases(values, keep=("path", "at"))


def read_pages(spark: SparkSession, base: str, token: str, paths: list[str], whole: bool = False, lenient: bool = False) -> DataFrame:
    spark.dataSource.register(RestSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("rest_pages").option("pushed", pushed).option("base", base).option("token", token).option("paths", ";".join(paths))
    return reader.option("whole", str(whole).lower()).option("lenient", str(lenient).lower()).load()


def token_of(spec: dict) -> str:
    """The connector's token: given as such, or by the name of an environment variable."""
    return (spec.get("token") or os.environ.get(spec.get("token_env") or "", "") or "").strip()


def _listing(kind: str, project: str) -> str:
    queries = {"folders": "folderType=TEST_CASE&", "statuses": "statusType=TEST_CASE&"}
    return f"{kind}?{queries.get(kind, '')}projectKey={urllib.parse.quote(project)}&maxResults={PAGE}"


def _per_case(spark: SparkSession, cases: DataFrame, base: str, token: str, tail: str, whole: bool) -> DataFrame:
    """key, value of a request for each case; executors fetch, as many at once as there are tasks.  A request that fails gives no row."""

    def run(batches):
        import pandas as pd

        fetch = lambda url: _fetch(url, token)
        for batch in batches:
            for key in batch["key"]:
                path = f"testcases/{urllib.parse.quote(key)}/{tail}"
                try:
                    values = [fetch(f"{base.rstrip('/')}/{path}")] if whole else list(pages(fetch, base, path))
                except OSError:
                    continue
                yield pd.DataFrame({"key": [key] * len(values), "value": [json.dumps(v) for v in values]}, dtype=object)

    # a listing comes from one task; requests are dealt to all
    return cases.repartition(REQUESTS, "key").mapInPandas(run, "key string, value string")


def fetch(spark: SparkSession, base: str, token: str, project: str, include_steps: bool = True, include_links: bool = True, held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cases, folders, statuses, priorities) of a project from the service.

    Steps are asked for only where a case has none inline, links for every case;
    cases, statuses and priorities whose lookup fails keep what is known without it.  The
    listing is fetched once and cached; ``held`` gets it, for its release.
    """
    raw = read_pages(spark, base, token, [_listing("testcases", project)]).select("value").persist()
    if held is not None:
        held.append(raw)
    bare = raw.select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.testScript.steps").alias("inline")).where("key IS NOT NULL")
    steps = _per_case(spark, bare.where("inline IS NULL").select("key"), base, token, f"teststeps?maxResults={PAGE}", False) if include_steps else None
    links = _per_case(spark, bare.select("key"), base, token, "links", True) if include_links else None
    cases = parse_cases(raw, steps, links)
    if not include_steps:
        cases = cases.withColumn("steps", F.lit(None).cast(cases.schema["steps"].dataType))
    ref = "id long, name string"
    named_rows = lambda kind, lenient: read_pages(spark, base, token, [_listing(kind, project)], lenient=lenient).select(F.from_json("value", ref).alias("r")).select("r.*")
    folders = read_pages(spark, base, token, [_listing("folders", project)]).select(F.from_json("value", "id long, name string, parentId long").alias("r")).select("r.id", "r.name", F.col("r.parentId").alias("parent_id"))
    return cases, folders, named_rows("statuses", True), named_rows("priorities", True)


def owner_text(owner: Column) -> Column:
    """An owner (JSON) that is a string, or an object with accountId; else null."""
    v = F.try_parse_json(owner)
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.accountId", "string"))


def inline_steps(wrapped: Column) -> Column:
    """The steps inside their wrappers, nulls dropped."""
    return F.filter(F.transform(wrapped, lambda w: w["inline"]), lambda s: s.isNotNull())


def links_union(issues: Column, web: Column) -> Column:
    """Issue links with a target, then web links, as array<struct<issue_key, url>>."""
    none = F.lit(None).cast("string")
    a = F.transform(F.filter(issues, lambda x: x["target"]["issueKey"].isNotNull()), lambda x: F.struct(x["target"]["issueKey"].alias("issue_key"), none.alias("url")))
    b = F.transform(web, lambda x: F.struct(none.alias("issue_key"), x["url"].alias("url")))
    empty = F.array().cast("array<struct<issue_key:string,url:string>>")
    return F.concat(F.coalesce(a, empty), F.coalesce(b, empty))


_STEP = "struct<index:bigint,description:string,testData:string,expectedResult:string,customFields:string>"
_CASE = f"""struct<id:bigint,key:string,name:string,folder:struct<id:bigint,name:string>,status:struct<id:bigint,name:string>,priority:struct<id:bigint,name:string>,owner:string,
objective:string,precondition:string,labels:array<string>,testScript:struct<type:string,steps:array<{_STEP}>,text:string>,createdOn:string,updatedOn:string>"""


def _steps(steps: Column) -> Column:
    fields = lambda s: F.from_json(s["customFields"], "map<string,string>")
    return F.transform(steps, lambda s: F.struct(s["index"].alias("index"), s["description"].alias("description"), s["testData"].alias("test_data"), s["expectedResult"].alias("expected_result"), fields(s).alias("custom_fields")))


def parse_cases(raw: DataFrame, steps: DataFrame | None = None, links: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Test cases (schemas.TEST_CASES) from JSON values as the service sends them.

    raw: value; steps: key, value (a page's wrapped step) for cases whose steps are not
    inline; links: key, value (issueLinks, webLinks).  Cases without either keep none.
    ``keep``: columns of raw that come before those of a case.
    """
    owner = owner_text(F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.owner", "variant")))
    out = raw.select(*keep, F.from_json("value", _CASE).alias("c"), owner.alias("owner_id")).where("c.key IS NOT NULL").select(*keep, "c.*", "owner_id")
    if steps is not None:
        wrapped = steps.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.from_json("value", f"struct<inline:{_STEP}>")).alias("_w"))
        out = out.join(wrapped, F.col("key") == F.col("_k"), "left").drop("_k")
    else:
        out = out.withColumn("_w", F.lit(None).cast(f"array<struct<inline:{_STEP}>>"))
    if links is not None:
        parsed = links.select(F.col("key").alias("_lk"), F.from_json("value", "struct<issueLinks:array<struct<target:struct<issueKey:string>>>,webLinks:array<struct<url:string>>>").alias("_l"))
        out = out.join(parsed, F.col("key") == F.col("_lk"), "left").drop("_lk").withColumn("_links", links_union(F.col("_l.issueLinks"), F.col("_l.webLinks")))
    else:
        out = out.withColumn("_links", F.lit(None).cast("array<struct<issue_key:string,url:string>>"))
    return out.select(
        *keep, "id", "key", "name", "folder", "status", "priority", F.col("owner_id").alias("owner"), "objective", "precondition", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        _steps(F.coalesce("testScript.steps", inline_steps(F.col("_w")))).alias("steps"), F.col("testScript.text").alias("script_text"), F.col("testScript").isNotNull().alias("has_script"), F.col("_links").alias("links"),
        F.col("createdOn").alias("created_on"), F.col("updatedOn").alias("updated_on"),
    )


def named(cases: DataFrame, statuses: DataFrame, priorities: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds status_name, priority_name (the inline name, or by id, or Unknown) and folder_path (or ``(unfiled)``)."""
    s = F.broadcast(statuses.select(F.col("id").alias("_sid"), F.col("name").alias("_sname")))
    p = F.broadcast(priorities.select(F.col("id").alias("_pid"), F.col("name").alias("_pname")))
    f = paths.select(F.col("id").alias("_fid"), F.col("path").alias("_path"))
    out = cases.join(s, F.col("status.id") == F.col("_sid"), "left").join(p, F.col("priority.id") == F.col("_pid"), "left").join(f, F.col("folder.id") == F.col("_fid"), "left")
    unknown = F.lit("Unknown")
    return (
        out.withColumn("status_name", F.coalesce("status.name", "_sname", unknown))
        .withColumn("priority_name", F.coalesce("priority.name", "_pname", unknown))
        .withColumn("folder_path", F.coalesce("_path", F.lit("(unfiled)")))
        .drop("_sid", "_sname", "_pid", "_pname", "_fid", "_path")
    )


def _section(title: str, html: Column) -> Column:
    md = html_to_md(F.coalesce(html, F.lit("")))
    return F.when(md != "", F.concat(F.lit(title), md, F.lit("\n"))).otherwise(F.lit(""))


def _step(step: Column, nth: Column) -> Column:
    index = F.coalesce(step["index"], F.lit(0))
    head = F.concat(F.lit("\n### Step "), (nth + 1).cast("string"), F.when(index > 0, F.concat(F.lit(" (Index "), index.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit("\n"))
    entries = F.array_sort(F.map_entries(step["custom_fields"]))
    fields = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- `"), e["key"], F.lit("`: "), F.coalesce(e["value"], F.lit("null")), F.lit("\n"))), "")
    custom = F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, F.concat(F.lit("\n**Custom Fields**\n"), fields)).otherwise(F.lit(""))
    return F.concat(head, _section("\n**Description**\n", step["description"]), _section("\n**Test Data**\n", step["test_data"]), _section("\n**Expected Result**\n", step["expected_result"]), custom)


def render(cases: DataFrame, project: str) -> DataFrame:
    """Adds title and markdown; cases are ``named``."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\n"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    links = F.coalesce("links", F.array().cast("array<struct<issue_key:string,url:string>>"))
    each = F.transform(links, lambda x: F.concat(F.coalesce(F.concat(F.lit("  - issue: "), x["issue_key"], F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.lit("  - url: "), x["url"], F.lit("\n")), F.lit(""))))
    head = [
        F.lit("---\n"), line("key", F.col("key")), line("name", yaml_scalar(F.col("name"))), line("project", F.lit(project)), line("folder", F.col("folder_path")),
        line("status", F.col("status_name")), line("priority", F.col("priority_name")), line("owner", text("owner")), line("labels", F.concat(F.lit("["), F.array_join(labels, ", "), F.lit("]"))),
        F.when(F.size(links) > 0, F.concat(F.lit("links:\n"), F.array_join(each, ""))).otherwise(F.lit("")), line("created_on", text("created_on")), line("updated_on", text("updated_on")), F.lit("---\n\n"),
    ]
    title = F.concat_ws(": ", "key", "name")
    steps = F.array_sort(F.transform("steps", lambda s, i: F.struct(F.coalesce(s["index"], F.lit(0)).alias("_at"), i.alias("_i"), s.alias("s"))), lambda a, b: F.when(F.struct(a["_at"], a["_i"]) < F.struct(b["_at"], b["_i"]), -1).otherwise(1))
    has_steps = F.coalesce(F.size("steps"), F.lit(0)) > 0
    script = F.coalesce("script_text", F.lit(""))
    body = (
        F.when(has_steps, F.concat(F.lit("\n## Test Steps\n"), F.array_join(F.transform(steps, lambda s, i: _step(s["s"], i)), "")))
        .when(F.coalesce("has_script", F.lit(False)), F.when(script != "", F.concat(F.lit("\n## Test Script (No Step Sequence Available)\n\n```text\n"), script, F.lit("\n```\n"))).otherwise(F.lit("")))
        .otherwise(F.lit("\n_No test steps available._\n"))
    )
    markdown = F.concat(*head, F.lit("# "), title, F.lit("\n"), _section("\n## Objective\n\n", F.col("objective")), _section("\n## Precondition\n\n", F.col("precondition")), body)
    return cases.withColumn("title", title).withColumn("markdown", markdown)


def envelopes(cases: DataFrame, folders: DataFrame, statuses: DataFrame, priorities: DataFrame, project: str, folder_path: str | None = None, classification: str = "internal", doc_type: str = "test_case") -> DataFrame:
    """Envelopes of the project's test cases (schemas.TEST_CASES), of a folder and what is below it if a path is given."""
    if folder_path is not None:
        found = [r.id for r in find_by_path(folders, folder_path).collect()]
        if not found:
            raise ValueError(f"folder_path '{folder_path}' not found in project {project}")
        scope = reduce(lambda a, b: a.unionByName(b), (subtree(folders, i) for i in found)).distinct()
        cases = cases.join(scope.withColumnRenamed("id", "_scope"), F.col("folder.id") == F.col("_scope"), "left_semi")
    rows = render(named(cases, statuses, priorities, folder_paths(folders)), project)
    tags = F.concat(F.array(F.lit(PLUGIN), F.lit(project)), F.coalesce("labels", F.array().cast("array<string>")))
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(1).alias("schema_version"),
        F.struct(F.lit(PLUGIN).alias("plugin_id"), F.lit(f"{PLUGIN}:{project}").alias("connector_instance"), F.col("key").alias("external_id"), none.alias("uri")).alias("source"),
        F.struct(F.concat(F.lit(f"{PLUGIN}:{project}:"), "key").alias("doc_id"), "title", "markdown", content_hash(F.col("markdown")).alias("content_hash"), F.coalesce("updated_on", "created_on", F.lit("1970-01-01T00:00:00Z")).alias("source_updated_at"), F.lit(False).alias("deleted")).alias("document"),
        F.struct(F.lit(doc_type).alias("doc_type"), F.lit(classification).alias("classification"), tags.alias("tags"), none.alias("language"), F.lit(None).cast("array<string>").alias("acl_tags"), none.alias("frontmatter_json")).alias("metadata"),
        F.lit(0).cast("long").alias("seq"),
    )
