"""The engine: sync of connectors, incremental indexing, search and catalogue."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions.analysis import analysed, tokens
from ..functions.chunking import chunk_documents
from ..functions.embedding import embed_column, service
from ..operators import catalog, ingest, reconcile
from ..operators import retrieval as R
from ..operators.retrieval import SearchError
from ..sources import filesystem, testcases
from .store import RETRIES, Conflict, Store, Write, append_meta, metas, now

#: Frequencies and sizes are partial sums, added up by queries.
_POSTINGS = schemas.StructType([*schemas._s("doc_id"), schemas.StructField("chunk_ix", schemas.IntegerType()), schemas.StructField("dl", schemas.IntegerType()), *schemas._s("token"), schemas.StructField("tf", schemas.LongType())])
_FREQUENCIES = schemas.StructType([*schemas._s("token"), schemas.StructField("df", schemas.LongType())])
_SIZES = schemas.StructType([schemas.StructField("n", schemas.LongType()), schemas.StructField("tokens", schemas.LongType())])


class Engine:
    def __init__(self, spark: SparkSession, config: Config, embedder: Callable[[str], Callable] | None = None, stemmed: bool = True) -> None:
        self.spark, self.config, self.store = spark, config, Store(spark, config.home, config.buckets)
        self.by_id = {p.id: p for p in config.profiles}
        self.embedder = embedder or (lambda profile: service(self.by_id[profile].endpoint, self.by_id[profile].model))
        self.analyse = analysed if stemmed else tokens
        self._fetched: list[DataFrame] = []
        self.store.bootstrap(config.generation)

    # --- state ---------------------------------------------------------------

    @property
    def generation(self) -> str:
        return (self.store.read_json("manifest.json") or {}).get("active_generation") or self.config.generation

    def documents(self) -> DataFrame:
        return self.store.table("documents")

    def state(self) -> DataFrame:
        return self.store.table("index_state").where(F.col("generation_id") == self.generation)

    def policy(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.config.routing.items()), "classification string, profile_id string")

    def profiles(self) -> DataFrame:
        return self.spark.createDataFrame([(p.id, p.provider, p.endpoint, p.model, p.locality) for p in sorted(self.config.profiles, key=lambda p: p.id)], schemas.PROFILES)

    def readiness(self) -> DataFrame:
        return reconcile.readiness(self.profiles(), metas(self.store, list(self.by_id), self.generation)).orderBy("profile_id")

    # --- ingest --------------------------------------------------------------

    def ingest(self, envelopes: DataFrame, dry_run: bool = False, plugin: str | None = None) -> dict:
        """Merges envelopes (with seq) into the documents; returns counters.

        An envelope that breaks a rule fails the whole batch before anything is
        written.  Only rows of documents that change are written; if another writer changed
        their buckets meanwhile, the batch is merged again into what is there then.
        """
        envelopes = envelopes.persist()
        try:
            broken = ingest.validation_error(plugin if plugin is not None else F.col("source.plugin_id"))
            first = envelopes.select(F.col("document.doc_id").alias("id"), broken.alias("rule")).where("rule IS NOT NULL").orderBy("id", "rule").limit(1).collect()
            if first:
                raise ValueError(f"envelope '{first[0]['id']}' breaks rule '{first[0]['rule']}'")
            batch = ingest.flatten(envelopes)
            for attempt in range(RETRIES):
                try:
                    return self._merge(batch, dry_run)
                except Conflict:
                    if attempt == RETRIES - 1:
                        raise
        finally:
            envelopes.unpersist()

    def _merge(self, batch: DataFrame, dry_run: bool) -> dict:
        write = self.store.begin()
        stored = self.store.table("documents", buckets=self.store.touched("documents", batch.select("doc_id"), write.base), at=write.base)
        report = ingest.counters(ingest.actions(batch, stored.select("doc_id", "content_hash", "deleted"), dry_run)).first().asDict()
        changing = ingest.changing(batch, stored).persist()
        try:
            if not dry_run and changing.limit(1).count():
                rows = ingest.latest(stored, batch.join(changing, "doc_id", "left_semi"), F.lit(now()))
                write.upsert("documents", rows)
                blobs = rows.select("doc_id", "deleted", F.col("markdown_path").alias("path"), F.octet_length("markdown").cast("long").alias("size_bytes"), F.col("content_hash").alias("checksum"))
                write.upsert("blobs", blobs.where("NOT deleted").drop("deleted"), blobs.where("deleted").select("doc_id"))
                self._count(write, stored, rows)
                write.commit()
        finally:
            changing.unpersist()
        return report

    def _count(self, write: Write, stored: DataFrame, rows: DataFrame) -> None:
        """Stages what a write of ``rows`` does to the catalogue: tags' counts as differences, sketches anew for the buckets that it touches."""
        known = stored.join(rows.select("doc_id"), "doc_id", "left_semi")
        less = catalog.topic_counts(known).withColumn("n", -F.col("n"))
        write.add("topics", catalog.topic_counts(rows).unionByName(less), ["classification", "tag"], ["n"])
        touched = self.store.touched("documents", rows.select("doc_id"), write.base)
        columns = ["doc_id", "deleted", *catalog.DISTINCT.values()]
        whole = self.store.table("documents", buckets=touched, at=write.base).select(*columns).join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows.select(*columns))
        sketches = catalog.distinct_sketches(whole, self.store.bucket_of("documents", at=write.base).cast("string"))
        emptied = self.spark.createDataFrame([(str(b),) for b in touched], "part string")
        write.upsert("sketches", sketches, emptied, key="part")

    def connector(self, spec: dict) -> DataFrame:
        """The envelopes of one configured connector."""
        kind, shared = spec.get("type"), {k: spec[k] for k in ("classification", "doc_type") if k in spec}
        if kind == "filesystem":
            return filesystem.envelopes(self.spark, spec["root"], exclude=spec.get("exclude", []), extensions=tuple(spec.get("extensions", filesystem.TEXT_EXTENSIONS)), enrich=spec.get("enrich_diagrams", True), **shared)
        if kind == "testcases":
            if "landing" in spec:
                read = lambda name, schema: self.spark.read.schema(schema).json(f"{spec['landing']}/{name}")
                tables = read("cases", schemas.TEST_CASES), read("folders", schemas.FOLDERS), read("statuses", schemas._REF), read("priorities", schemas._REF)
            else:
                tables = testcases.fetch(self.spark, spec["base_url"], testcases.token_of(spec), spec["project"], spec.get("include_steps", True), spec.get("include_links", True), self._fetched)
            return testcases.envelopes(*tables, spec["project"], spec.get("folder_path"), **shared)
        raise ValueError(f"unknown connector type '{kind}'")

    def skipped(self, spec: dict, most: int = 1000) -> dict:
        """{"files": how many a filesystem connector left out, "first": [(path, reason), ...]}, or nothing."""
        rows = filesystem.skipped(self.spark, spec["root"], tuple(spec.get("extensions", filesystem.TEXT_EXTENSIONS)), spec.get("exclude", [])).persist()
        try:
            n = rows.count()
            return {"files": n, "first": [tuple(r) for r in rows.orderBy("rel_path").limit(most).collect()]} if n else {}
        finally:
            rows.unpersist()

    def sync(self, wanted: list[str] | None = None, include_disabled: bool = False, dry_run: bool = False, fail_fast: bool = False, index: bool = True) -> dict:
        """Runs connectors one by one, each failure its own; indexes if none failed."""
        chosen = self.config.select_connectors(wanted, include_disabled)
        report = {"selected": len(chosen), "run": 0, "succeeded": 0, "failed": 0, "skipped": len(self.config.connectors) - len(chosen), "errors": {}, "ingest": {}, "left_out": {}}
        for spec in chosen:
            report["run"] += 1
            try:
                report["ingest"][spec["id"]] = self.ingest(self.connector(spec), dry_run, {"filesystem": filesystem.PLUGIN, "testcases": testcases.PLUGIN}.get(spec["type"]))
                if spec["type"] == "filesystem" and (left := self.skipped(spec)):
                    report["left_out"][spec["id"]] = left
                report["succeeded"] += 1
            except Exception as e:  # noqa: BLE001  a connector's failure is reported and does not stop the others
                report["failed"] += 1
                report["errors"][spec["id"]] = str(e)
                if fail_fast:
                    break
            finally:
                while self._fetched:
                    self._fetched.pop().unpersist()
        report["index"] = "dry_run" if dry_run else "skipped_due_to_failures" if report["failed"] else self.index() if index else "off"
        return report

    # --- index ---------------------------------------------------------------

    def _chunks(self, profile: str) -> DataFrame:
        return self.store.table(f"chunks/{self.generation}/{profile}", schemas.CHUNKS)

    def _postings(self, profile: str) -> DataFrame:
        return self.store.table(f"postings/{self.generation}/{profile}", _POSTINGS)

    def index(self, force: bool = False) -> dict:
        """Chunks, embeds and indexes what changed.

        Each profile is one plan over its changed documents, and one commit: its chunks,
        postings, sums and index state as deltas of these documents.  A profile whose postings
        can't be built keeps its vectors, with a warning, and has them built from all its
        chunks the next time.  A profile's conflict with another indexer is tried again.
        """
        total = {"indexed": 0, "skipped": 0, "deleted": 0, "chunks": 0, "warnings": {}}
        for profile in sorted(self.by_id):
            for attempt in range(RETRIES):
                try:
                    counts, warning = self._index_profile(profile, force)
                    break
                except Conflict:
                    if attempt == RETRIES - 1:
                        raise
            total |= {k: total[k] + n for k, n in counts.items()}
            if warning:
                total["warnings"][profile] = warning
        return total

    def _index_profile(self, profile: str, force: bool) -> tuple[dict, str | None]:
        write = self.store.begin()
        at, place = write.base, f"indexes/{self.generation}/{profile}/index_meta.json"
        meta = self.store.read_json(place) or {}
        rebuild = force or (bool(meta) and meta.get("schema_version") != reconcile.INDEX_SCHEMA)
        routed = reconcile.route(self.store.table("documents", at=at), self.policy(), self.config.default_profile)
        state = self.store.table("index_state", at=at).where(F.col("generation_id") == self.generation)
        mine = routed.where((F.col("embedding_profile_id") == profile) & ~F.coalesce("deleted", F.lit(False)))
        todo = reconcile.changed(mine, state, rebuild).select("doc_id", "content_hash", "markdown_path", "markdown").persist()
        away = reconcile.stale(state, routed).where(F.col("embedding_profile_id") == profile).persist()
        held = [todo, away]
        try:
            n_todo, n_away, n_all = todo.count(), away.count(), mine.count()
            counts, warning = {"indexed": n_todo, "skipped": n_all - n_todo, "deleted": n_away, "chunks": 0}, None
            if not (n_todo or n_away or meta.get("keyword_stale")):
                return counts, None
            parts = chunk_documents(todo.select("doc_id", "markdown"), "markdown", self.config.chunk_size, self.config.chunk_overlap)
            fresh = parts.select("doc_id", "chunk_ix", F.col("chunk_text").alias("text")).withColumn("vector", embed_column(F.col("text"), self.embedder(profile))).persist()
            held.append(fresh)  # an embedding is asked for once
            counts["chunks"] = fresh.count()
            gone = todo.select("doc_id").unionByName(away.select("doc_id"))
            if rebuild:
                write.replace(f"chunks/{self.generation}/{profile}", fresh)
            else:
                write.upsert(f"chunks/{self.generation}/{profile}", fresh, gone)
            try:
                self._keyword(write, profile, fresh, gone, rebuild or bool(meta.get("keyword_stale")))
            except Conflict:
                raise
            except Exception as e:  # noqa: BLE001  vectors stay usable
                warning = f"keyword index not built: {e}"
                for kind in ("postings", "frequencies", "sizes"):
                    write.staged.pop(f"{kind}/{self.generation}/{profile}", None)
            per_doc = fresh.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
            rows = reduce(lambda a, b: a.unionByName(b), self._states(profile, todo, away, per_doc))
            # an upsert replaces a document's rows: those of other profiles and generations go along
            touched = self.store.touched("index_state", rows.select("doc_id"), at)
            stored = self.store.table("index_state", buckets=touched, at=at).join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
            write.upsert("index_state", ingest.upsert(stored, rows, ["doc_id", "generation_id", "embedding_profile_id"]))
            write.commit()
            append_meta(self.store, profile, self.generation, self.by_id[profile].model, chunk_count=counts["chunks"], file_count=n_all, keyword_stale=warning is not None)
            return counts, warning
        finally:
            for frame in held:
                frame.unpersist()

    def _keyword(self, write: Write, profile: str, fresh: DataFrame, gone: DataFrame, rebuild: bool) -> None:
        """Stages postings, and as partial sums the terms' frequencies and the number and length of chunks, for what a write does to a profile's chunks."""
        at, keys = write.base, ["doc_id", "chunk_ix"]
        postings, frequencies, sizes = (f"{kind}/{self.generation}/{profile}" for kind in ("postings", "frequencies", "sizes"))
        if rebuild:
            chunks = f"chunks/{self.generation}/{profile}"
            whole = fresh if write.staged[chunks][1] and all(how == "base" for how, _ in write.staged[chunks][1].values()) else self.store.table(chunks, schemas.CHUNKS, at=at).join(gone.distinct(), "doc_id", "left_anti").unionByName(fresh)
            old = old_chunks = None
        else:
            whole = fresh
            old = self.store.table(postings, _POSTINGS, at=at).join(gone.distinct(), "doc_id", "left_semi")
            old_chunks = self.store.table(f"chunks/{self.generation}/{profile}", schemas.CHUNKS, at=at).join(gone.distinct(), "doc_id", "left_semi").select(*keys)
        index = R.postings(whole, keys, "text", self.analyse).persist()
        try:
            # in the order of tokens, so that a query skips row groups
            if rebuild:
                write.replace(postings, index, sort=("token",))
            else:
                write.upsert(postings, index, gone, sort=("token",))
            counts = index.groupBy("token").agg(F.count("*").alias("df"))
            lengths = lambda rows, of: rows.join(of.groupBy(*keys).agg(F.first("dl").alias("dl")), keys, "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("tokens"))
            size = lengths(whole.select(*keys), index)
            if not rebuild:
                counts = counts.unionByName(old.groupBy("token").agg((-F.count("*")).alias("df")))
                size = size.unionByName(lengths(old_chunks, old).select((-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens")))
            write.add(frequencies, counts, ["token"], ["df"], sort=("token",), fresh=rebuild)
            write.add(sizes, size, [], ["n", "tokens"], fresh=rebuild)
        finally:
            index.unpersist()

    def _states(self, profile: str, todo: DataFrame, away: DataFrame, counts: DataFrame) -> list[DataFrame]:
        """Index-state rows of the documents just indexed and of those removed; a blank document is indexed with no chunk."""
        at = now()
        row = lambda d, status: d.select("doc_id", F.lit(self.generation).alias("generation_id"), F.lit(profile).alias("embedding_profile_id"), F.lit(status).alias("status"), "chunk_count", "indexed_content_hash", "indexed_markdown_path", F.lit(at).alias("embedded_at"), F.lit(at).alias("updated_at"))
        done = todo.join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.col("content_hash").alias("indexed_content_hash"), F.col("markdown_path").alias("indexed_markdown_path"))
        left = away.select("doc_id", F.lit(None).cast("long").alias("chunk_count"), F.lit(None).cast("string").alias("indexed_content_hash"), F.col("delete_path").alias("indexed_markdown_path"))
        return [row(done, "indexed"), row(left.join(todo.select("doc_id"), "doc_id", "left_anti"), "deleted")]

    # --- search --------------------------------------------------------------

    def _hits(self, profile: str, query: str, mode: R.Mode, n: int, threshold: float) -> DataFrame:
        keys, chunks = ["doc_id", "chunk_ix"], self._chunks(profile)
        terms = [r.t for r in self.spark.range(1).select(F.explode(F.array_distinct(self.analyse(F.lit(query)))).alias("t")).collect()]
        sizes = self.store.table(f"sizes/{self.generation}/{profile}", _SIZES)
        stats = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl"))
        frequencies = self.store.table(f"frequencies/{self.generation}/{profile}", _FREQUENCIES).where(F.col("token").isin(terms)).groupBy("token").agg(F.sum("df").alias("df"))
        keyword = R.bm25_from_index(self._postings(profile), stats, frequencies, keys, terms)
        vector = R.query_vector(lambda texts: self.embedder(profile)(texts), query, mode)
        if mode is R.Mode.SEMANTIC:
            found = R.top(R.semantic(chunks, keys, "vector", vector), keys, n).where(F.col("score") >= threshold)
        elif vector is None:
            found = R.top(keyword, keys, n)
        else:
            found = R.top(R.fuse(keyword, R.semantic(chunks, keys, "vector", vector), keys, n), keys, n)
        return chunks.select(*keys, "text").join(F.broadcast(found), keys).select("doc_id", "text", R.rounded(F.col("score")).alias("score"))  # n rows at most

    def search(self, query: str, where: R.SearchFilter | None = None, group_by_doc: bool = False, limit: int | None = None, mode: R.Mode | str = R.Mode.HYBRID) -> list[dict]:
        """Results as dictionaries, best first; filters apply after the candidates are fetched."""
        mode = R.Mode.parse(mode) if not isinstance(mode, R.Mode) else mode
        limit = self.config.top_k if limit is None else limit
        ready = [r.profile_id for r in self.readiness().where("queryable").collect()]
        n, hits, errors = R.candidates(self.config.top_k, limit), [], {}
        for profile in ready:
            found = self._hits_or_error(profile, query, mode, n, errors)
            if found is not None:
                hits.append(found)
        if not hits:
            raise SearchError(f"no profile could be searched: {errors or 'none is ready'}")
        try:
            rows = R.attach(reduce(lambda a, b: a.unionByName(b), hits), self.documents(), where)
            rows = rows.select("doc_id", "title", "doc_type", "classification", F.coalesce("uri", "markdown_path").alias("file"), "text", "score", "frontmatter_json")
            found = (R.document_results(rows, limit) if group_by_doc else R.chunk_results(rows, limit)).collect()
        finally:
            for frame in hits:
                frame.unpersist()
        results = []
        for r in found:
            d = r.asDict() | {"search_mode": mode.value}
            extra = d.pop("frontmatter_json")
            if group_by_doc:
                value = json.loads(extra or "null")
                d["frontmatter"] = value if isinstance(value, dict) else None
            results.append(d)
        return results

    def _hits_or_error(self, profile: str, query: str, mode: R.Mode, n: int, errors: dict[str, str]) -> DataFrame | None:
        """A profile's candidates, computed and cached, or null and what went wrong; one profile's failure is its own."""
        frame = None
        try:
            frame = self._hits(profile, query, mode, n, self.config.threshold).persist()
            frame.count()
        except Exception as e:  # noqa: BLE001
            errors[profile] = str(e)
            if frame is not None:
                frame.unpersist()
            return None
        return frame

    def search_books(self, query: str, where: R.SearchFilter | None = None, group_by_doc: bool = False, **options) -> list[dict]:
        return self.search(query, replace(where or R.SearchFilter(), doc_type="book"), group_by_doc=group_by_doc, **options)

    def search_library(self, query: str, **options) -> list[dict]:
        return self.search(query, **options)

    def books(self) -> list[dict]:
        routed = reconcile.route(self.documents(), self.policy(), self.config.default_profile)
        return [r.asDict() for r in catalog.list_books(routed, self.state()).collect()]

    def topics(self, classification: str | None = None) -> list[dict]:
        """Tags of live documents from their partial counts, without a look at the documents."""
        return [r.asDict() for r in catalog.topics_from_counts(self.store.table("topics", schemas.TOPICS), classification).collect()]

    def distinct(self) -> dict[str, int]:
        """About how many contents, sources and titles the live documents have."""
        return {r.what: r.n for r in catalog.distinct_counts(self.store.table("sketches", schemas.SKETCHES)).collect()}

    def startup(self) -> dict:
        """Whether anything can be served: active generation, profiles that can be queried, and the issues of the others."""
        rows = self.readiness().collect()
        issues = [f"{r.profile_id}: {r.issue}" for r in rows if not r.queryable]
        return {"active_generation": self.generation, "total_profiles": len(rows), "queryable_profiles": sum(r.queryable for r in rows), "issues": issues}

    def doctor(self) -> dict:
        """Health of configuration, connectors, migrations, embedders, indexes and serving; nothing of it raises."""
        migrations = {r.component: r.status for r in reconcile.migration_status(self.store.versions()).collect()}
        profiles = {}
        for p in sorted(self.by_id):
            meta = self.store.read_json(f"indexes/{self.generation}/{p}/index_meta.json") or {}
            try:
                self.embedder(p)(["ping"])
                embedder = "ok"
            except Exception as e:  # noqa: BLE001
                embedder = f"unreachable: {e}"
            profiles[p] = {"embedder": embedder, "model": self.by_id[p].model} | {k: meta.get(k) for k in ("schema_version", "embedding_model", "file_count", "chunk_count")}
        issues = {r.profile_id: r.issue for r in self.readiness().collect()}
        startup = self.startup()
        connectors = [{"id": c["id"], "type": c.get("type"), "enabled": c.get("enabled", True), "issues": found, "status": "warn" if found else "ok"} for c in self.config.connectors for found in [connector_issues(c)]]
        failures = [f"connector {c['id']}: {i}" for c in connectors if c["enabled"] for i in c["issues"]] + [f"{k}: {v}" for k, v in migrations.items() if v != "ok"]
        try:
            documents = self.documents().count()
        except Exception as e:  # noqa: BLE001
            documents = None
            failures.append(f"store: {e}")
        failures += [f"profile {p}: {v['embedder']}" for p, v in profiles.items() if v["embedder"] != "ok"] + ([] if startup["queryable_profiles"] else ["no profile can be served"])
        return {
            "home": self.config.home, "active_generation": self.generation, "documents": documents, "connectors": connectors, "migrations": migrations, "up_to_date": all(s == "ok" for s in migrations.values()),
            "profiles": {p: issues.get(p) for p in profiles}, "indexes": profiles, "serving": startup, "serve_ready": startup["queryable_profiles"] > 0, "failures": failures,
        }


def connector_issues(spec: dict) -> list[str]:
    """What would keep a configured connector from running here."""
    kind, found = spec.get("type"), []
    if kind == "filesystem":
        root = spec.get("root")
        if not root:
            found.append("root is not configured")
        elif "://" not in root and not os.path.exists(root):
            found.append(f"root {root} does not exist")
        wanted = {e.lower() for e in spec.get("extensions", [])}
        for extensions, tools in ((filesystem.PDF, ("docling",)), (filesystem.PANDOC, ("pandoc",)), (filesystem.SLIDES, ("markitdown", "pandoc"))):
            if wanted & set(extensions) and not any(shutil.which(t) for t in tools):
                found.append(f"{' or '.join(tools)} not found (needed for {', '.join(sorted(wanted & set(extensions)))})")
    elif kind == "testcases":
        found += [f"{k} is not configured" for k in (("project",) if "landing" in spec else ("project", "base_url")) if not spec.get(k)]
        if "landing" not in spec and not testcases.token_of(spec):
            found.append("no API token: set token, or token_env and that variable")
    else:
        found.append(f"unknown connector type '{kind}'")
    return found
