"""Commands over an archive; each prints one JSON object."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lodestrata import __version__, schema
from lodestrata.operators import connections, jobs, search, store
from lodestrata.session import cut_lineage, local_session
from lodestrata.sources import readers


def _plain(value):
    return value.isoformat() if isinstance(value, datetime) else str(value)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _queries(words: str) -> list[str]:
    value = json.loads(words) if words.lstrip().startswith("[") else [words]
    if not isinstance(value, list) or not 1 <= len(value) <= search.MAX_QUERIES or not all(isinstance(q, str) and q.strip() for q in value):
        raise store.ArchiveError("INVALID_QUERIES", "one to six non-empty queries are needed")
    return value


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestrata")
    parser.add_argument("--space", default="./archive", help="folder of the archive")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version")
    for name in ("init", "overview", "status", "sources", "doctor"):
        verbs.add_parser(name)
    for name in ("import", "import-file"):
        p = verbs.add_parser(name)
        p.add_argument("path")
        _attribution(p, "--as")
    for name in ("setup", "enter", "sync", "sync-status"):
        p = verbs.add_parser(name)
        if name != "setup":
            p.add_argument("target", nargs="?")
        if name == "enter":
            _attribution(p, "--as")
        if name == "sync":
            p.add_argument("--restart", action="store_true")
    for name in ("search", "query"):
        p = verbs.add_parser(name)
        p.add_argument("queries")
        p.add_argument("--limit", type=int, default=8)
    p = verbs.add_parser("recall")
    p.add_argument("queries")
    p.add_argument("--mode", choices=schema.MODES, required=True)
    p.add_argument("--limit", type=int, default=8)
    p.add_argument("--include", choices=["reference"])
    p = verbs.add_parser("remember")
    for name in ("title", "content", "occurred_at"):
        p.add_argument(name)
    p.add_argument("--context")
    p = verbs.add_parser("mark")
    p.add_argument("source")
    p.add_argument("--purpose", choices=schema.PURPOSES, required=True)
    p.add_argument("--authorship", choices=schema.AUTHORSHIPS)
    p.add_argument("--scope", choices=schema.SCOPES)
    p = verbs.add_parser("read")
    p.add_argument("source")
    p.add_argument("--start", type=int, default=1)
    p.add_argument("--end", type=int)
    p.add_argument("--all", action="store_true")
    verbs.add_parser("remove").add_argument("source")
    verbs.add_parser("export").add_argument("path")
    return parser


def _attribution(parser: argparse.ArgumentParser, purpose: str) -> None:
    parser.add_argument(purpose, dest="purpose", choices=schema.PURPOSES)
    parser.add_argument("--authorship", choices=schema.AUTHORSHIPS)
    parser.add_argument("--content-scope", dest="scope", choices=schema.SCOPES)


def _documents(spark, path: str, given: dict[str, str | None], connection: str | None = None):
    """(documents, skipped) of a file or folder, the entries of its ZIP archives included; ``given`` is the attribution stated for all."""
    files = readers.limited(readers.list_files(spark, path))
    entries = cut_lineage(readers.zip_entries(readers.list_files(spark, path, archives=True)))
    documents = readers.read_documents(files.filter("skip_code is null").select("path", "modified_at", "content")).unionByName(readers.entry_documents(entries))
    stated = {name: F.coalesce(F.lit(value), F.col(name) if name in documents.columns else F.lit(None).cast("string")) for name, value in given.items()}
    documents = documents.withColumns({**stated, "connection_id": F.lit(connection).cast("string")})
    skipped = files.filter("skip_code is not null").select("path", "skip_code")
    return documents, skipped.unionByName(entries.filter("skip_code is not null").select(F.concat("archive", F.lit("#"), "name").alias("path"), "skip_code"))


def _given(args) -> dict[str, str | None]:
    return {"purpose": args.purpose, "authorship": args.authorship, "content_scope": args.scope}


def _sync(spark, archive: store.Archive, connection, restart: bool = False) -> dict:
    """One import of a connection under a job; pages, wikis and repositories are fetched outside and wait for their rows."""
    ledger = archive.ledger("jobs")
    active = jobs.active(ledger, connection.connection_id).head()
    now = datetime.now(timezone.utc)
    if active and not restart:
        return active.asDict()
    if active:
        ledger = jobs.append(ledger, {"job_id": active.job_id, "connection_id": connection.connection_id, "state": "failed", "error": "restarted", "created_at": active.created_at, "updated_at": now})
    job = uuid.uuid4().hex
    if connection.kind != "local":
        row = {"job_id": job, "connection_id": connection.connection_id, "state": "pending", "created_at": now, "updated_at": now}
        archive.write({"jobs": jobs.append(ledger, row)})
        return row
    given = {n: connection[n] for n in ("purpose", "authorship", "content_scope")}
    documents, skipped = _documents(spark, connection.input, given, connection.connection_id)
    ledger = cut_lineage(jobs.run(archive, ledger, job, connection.connection_id, documents, skipped.count()))
    registry = archive.ledger("connections")
    synced = F.when(F.col("connection_id") == connection.connection_id, F.lit(now)).otherwise(F.col("last_synced_at"))
    archive.write({"jobs": ledger, "connections": registry.withColumn("last_synced_at", synced)})
    return jobs.latest(ledger).filter(F.col("job_id") == job).head().asDict()


def run(spark, args) -> object:
    archive = store.Archive(spark, args.space)
    if args.verb in ("init", "setup", "enter") and not archive.exists():
        archive.save(store.empty(spark))
    if args.verb in ("init", "setup"):
        return {"space": args.space} | store.status(archive.tables().sources, archive.tables().chunks).head().asDict()
    if not archive.exists():
        raise store.ArchiveError("SPACE_NOT_FOUND", f"no archive at {args.space}")
    tables = archive.tables()
    match args.verb:
        case "import" | "import-file":
            documents, skipped = _documents(spark, args.path, _given(args))
            refused = store.refused(store.conform(documents)).select(F.col("origin").alias("path"), F.col("code").alias("skip_code"))
            archive.add(documents)
            return {"skipped": _rows(skipped.unionByName(refused).limit(readers.MAX_ENTRIES))} | store.status(archive.tables().sources, archive.tables().chunks).head().asDict()
        case "enter":
            registry = archive.ledger("connections")
            if args.target:
                stated = {k: v for k, v in _given(args).items() if v}
                wanted = connections.connect(registry, spark.createDataFrame([(args.target,)], "input string"))
                fresh = wanted.join(registry.select("connection_id"), "connection_id", "left_anti").withColumns({k: F.lit(v) for k, v in stated.items()})
                archive.write({"connections": cut_lineage(registry.unionByName(fresh))})
                registry = archive.ledger("connections")
                key = connections.normalized_input(F.lit(args.target))
                chosen = registry.filter(F.col("input") == key).collect()
            else:
                # Connections are typed in by a person, so they are few.
                chosen = registry.collect()
            syncs = [_sync(spark, archive, c) for c in chosen]
            summary = store.overview(archive.tables().sources)
            return {"connections": registry.count(), "syncs": syncs, "overview": summary.head().asDict(), "card": store.card(summary).head().card}
        case "sync":
            registry = archive.ledger("connections")
            chosen = (registry.filter(F.col("connection_id") == args.target) if args.target else registry).collect()
            if not chosen:
                raise store.ArchiveError("CONNECTION_NOT_FOUND", "no connection; enter a path or an address first")
            return {"jobs": [_sync(spark, archive, c, args.restart) for c in chosen], "overview": store.overview(archive.tables().sources).head().asDict()}
        case "sync-status":
            rows = jobs.latest(archive.ledger("jobs"))
            found = (rows.filter(F.col("job_id") == args.target) if args.target else rows.orderBy(F.desc("updated_at"))).head()
            if found is None:
                raise store.ArchiveError("SYNC_JOB_NOT_FOUND", "no such job")
            return {"job": found.asDict()}
        case "search":
            return {"hits": _rows(search.search(tables, args.queries, args.limit))}
        case "query":
            return {"hits": _rows(search.query(tables, _queries(args.queries), args.limit))}
        case "recall":
            found = search.recall(tables, _queries(args.queries), args.mode, args.limit, args.include == "reference")
            return found.summary.head().asDict() | {"hits": _rows(found.hits)}
        case "remember":
            return {"origin": archive.remember(args.title, args.content, args.occurred_at, args.context)}
        case "mark":
            archive.mark(args.source, args.purpose, args.authorship, args.scope)
            return {"marked": args.source}
        case "remove":
            archive.remove(args.source)
            return {"removed": args.source}
        case "read":
            last = 2**31 - 2 if args.all else args.start + 199 if args.end is None else args.end
            found = _rows(store.read_range(tables.sources.filter(F.col("id") == args.source), tables.objects, 1 if args.all else args.start, last))
            if not found:
                raise store.ArchiveError("SOURCE_NOT_FOUND", f"no source {args.source}")
            return found[0]
        case "overview":
            return store.overview(tables.sources).head().asDict()
        case "status":
            return store.status(tables.sources, tables.chunks).head().asDict()
        case "sources":
            return {"sources": _rows(store.list_sources(tables.sources))}
        case "doctor":
            problems = {r.problem: r.n for r in store.doctor(tables).collect()}
            return {"healthy": not any(problems.values()), "problems": problems}
        case "export":
            # Written by the executors, so an archive of any size can leave.
            store.export_rows(tables.sources, tables.objects).write.mode("errorifexists").json(args.path)
            return {"path": args.path, "version": 3, "exported_at": datetime.now(timezone.utc)}


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.verb == "version":
        print(json.dumps({"ok": True, "version": __version__}))
        return 0
    try:
        print(json.dumps({"ok": True, "data": run(local_session(), args)}, ensure_ascii=False, default=_plain))
        return 0
    except (store.ArchiveError, ValueError) as error:
        print(json.dumps({"ok": False, "error": {"code": getattr(error, "code", "INVALID_INPUT"), "message": str(error)}}, ensure_ascii=False), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
