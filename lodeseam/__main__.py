"""``python -m lodeseam``: sync, index, search, topics, books, profiles, connectors, doctor, migrate, instructions, tour, import, serve."""

from __future__ import annotations

import argparse
import json
import sys

from .config import Config, key_value


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodeseam")
    p.add_argument("--config", default="~/.lodeseam/config.yaml")
    sub = p.add_subparsers(dest="command", required=True)
    sync = sub.add_parser("sync")
    sync.add_argument("--connector", action="append")
    for flag in ("--include-disabled", "--dry-run", "--fail-fast", "--no-index"):
        sync.add_argument(flag, action="store_true")
    sub.add_parser("index").add_argument("--force", action="store_true")
    search = sub.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--mode", default="hybrid")
    search.add_argument("--group-by-doc", action="store_true")
    for name in ("--doc-type", "--classification", "--since"):
        search.add_argument(name)
    for name in ("--path-includes", "--path-excludes", "--frontmatter"):
        search.add_argument(name, action="append", default=[])
    sub.add_parser("topics").add_argument("--classification")
    doctor = sub.add_parser("doctor")
    doctor.add_argument("--strict", action="store_true")
    imported = sub.add_parser("import")
    imported.add_argument("path")
    sub.add_parser("tour").add_argument("topic", nargs="?")
    serve = sub.add_parser("serve")
    serve.add_argument("--check", action="store_true")
    sub.add_parser("backup").add_argument("name", nargs="?")
    for name in ("restore", "drop-backup"):
        sub.add_parser(name).add_argument("name")
    for name in ("bootstrap", "books", "profiles", "connectors", "migrate", "instructions", "backups", "compact", "clean"):
        sub.add_parser(name)
    return p


#: Help by topic; each is printed as it stands.
TOUR = {
    "getting-started": "Write ~/.lodeseam/config.yaml with a profile and a connector, run `sync`, then `search QUERY`. `doctor` tells what is missing.",
    "concepts": "Connectors give envelopes; sync merges them into versioned tables. Each classification is routed to an embedding profile, which has an index of its own. A search asks every profile that is ready and ranks what they find.",
    "config": "home, profiles (id, provider, endpoint, model, locality), default_profile, routing (classification: profile), connectors (id, type, enabled, ...), generation, top_k, threshold, chunk_size, chunk_overlap, buckets. LODESEAM_HOME, LODESEAM_CONFIG, LODESEAM_TOP_K and LODESEAM_THRESHOLD override.",
    "use-cases": "Search notes and books by words, by meaning or both; serve the tools to an assistant over lines of JSON-RPC; keep a corpus current with a streamed landing folder.",
    "troubleshooting": "`doctor --strict` fails if nothing can be served. An outdated index: `index --force`. Pending migrations: `migrate`. An unreachable embedder: hybrid search falls back to words.",
}


def tour(topic: str | None) -> int:
    if topic is None:
        print("\n".join(["Topics:", *(f"- {t}" for t in sorted(TOUR))]))
    elif topic.strip() not in TOUR:
        print(f"unknown topic '{topic.strip()}'; one of: {', '.join(sorted(TOUR))}", file=sys.stderr)
        return 1
    else:
        print(TOUR[topic.strip()])
    return 0


def main(argv: list[str] | None = None, engine=None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "tour":
        return tour(args.topic)
    if engine is None:
        from pyspark.sql import SparkSession

        from .plans.engine import Engine

        engine = Engine(SparkSession.builder.appName("lodeseam").config("spark.sql.session.timeZone", "UTC").getOrCreate(), Config.load(args.config))
    show = lambda x: print(json.dumps(x, indent=1, default=str))
    rows = lambda df: [r.asDict() for r in df.collect()]
    match args.command:
        case "sync":
            report = engine.sync(args.connector, args.include_disabled, args.dry_run, args.fail_fast, not args.no_index)
            show(report)
            return int(report["failed"] > 0)
        case "index":
            show(engine.index(args.force))
        case "search":
            from .operators.retrieval import SearchFilter

            where = SearchFilter(args.doc_type, args.classification, args.path_includes, args.path_excludes, args.since, dict(map(key_value, args.frontmatter)))
            results = engine.search(args.query, where, args.group_by_doc, min(args.limit, engine.config.top_k), args.mode)
            show([r | {"text": r["text"][:200] + ("..." if len(r["text"].encode()) > 200 else "")} for r in results])
        case "topics":
            show(engine.topics(args.classification))
        case "books":
            show(engine.books())
        case "profiles":
            show(rows(engine.readiness()))
        case "connectors":
            show(engine.config.select_connectors(include_disabled=True))
        case "migrate" | "bootstrap":
            engine.store.bootstrap(engine.config.generation)
            show(engine.doctor()["migrations"])
        case "backup":
            show({"backup": engine.store.backup(args.name)})
        case "backups":
            show(engine.store.backups())
        case "restore":
            show({"snapshot": engine.store.restore(args.name)})
        case "drop-backup":
            return int(not engine.store.drop_backup(args.name))
        case "compact":
            show({name: engine.store.compact(name) for name in sorted(engine.store.snapshot()["tables"])})
        case "clean":
            show(engine.store.clean())
        case "doctor":
            report = engine.doctor()
            show(report)
            return int(args.strict and bool(report["failures"]))
        case "instructions":
            from .operators.catalog import counts_by_type

            counts = {r.doc_type or "all": r.n for r in counts_by_type(engine.documents()).collect()}
            print("\n".join(["# Library", "", *(f"- {k}: {n} documents" for k, n in sorted(counts.items())), "", "Search it with search_library or search_books; browse it with list_books and browse_topics."]))
        case "import":
            from .sources.filesystem import import_document

            show(engine.ingest(import_document(engine.spark, args.path)))
        case "serve":
            report = engine.startup()
            if args.check:
                show({"ready": report["queryable_profiles"] > 0} | report)
                return int(not report["queryable_profiles"])
            from .serve.jsonrpc import NotReady, Server

            try:
                Server(engine).serve()
            except NotReady as e:
                print(e, file=sys.stderr)
                return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
