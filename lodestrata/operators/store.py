"""The archive: content-addressed objects, versioned sources, and what changes them.

All operations take and give DataFrames.  ``Archive`` keeps them in a folder on
any file system that Hadoop knows, with a pointer that names the files of every
table.  Parquet tables know no updates: an operation writes what it changed or
added, and then moves the pointer.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import schema
from lodestrata.functions import chunking, dates, text
from lodestrata.operators import index
from lodestrata.session import cut_lineage

#: Headings of a kept entry and of its context, which are part of its identity.  The second one names no product, so ids of entries with a context are this engine's own.
MEMORY_TITLE, CONTEXT_TITLE = "你选择留下的话", "当时的背景"


class ArchiveError(ValueError):
    """A request that the archive refuses, with a code for programs."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def live(sources: DataFrame) -> DataFrame:
    """Sources that are neither removed nor superseded."""
    return sources.filter(F.col("deleted_at").isNull() & F.col("is_current").cast("boolean"))


def with_attribution(documents: DataFrame) -> DataFrame:
    """Purpose, authorship, scope, author and subject where a document states none."""
    chat = F.col("kind") == "chat"
    out = documents.withColumns(
        {
            "purpose": F.coalesce("purpose", F.when(chat, "memory").otherwise("reference")),
            "authorship": F.coalesce("authorship", F.when(chat, "mixed").otherwise("unknown")),
        }
    )
    by_user = F.col("authorship") == "user"
    out = out.withColumn("content_scope", F.coalesce("content_scope", F.when(by_user & (F.col("purpose") == "memory"), "personal").otherwise("unknown")))
    return out.withColumns(
        {
            "author": F.coalesce(text.tidy(F.col("author")), F.when(by_user, "user")),
            "subject": F.coalesce(text.tidy(F.col("subject")), F.when(by_user & (F.col("content_scope") == "personal"), "user")),
            "speaker": text.tidy(F.col("speaker")),
            "external_id": text.tidy(F.col("external_id")),
            "connection_id": text.tidy(F.col("connection_id")),
        }
    )


def with_event_time(documents: DataFrame) -> DataFrame:
    """occurred_at, occurred_end and where they come from: stated, or inferred from title, origin and lines."""
    stated, stated_end = dates.normalize_date(F.col("occurred_at")), dates.normalize_date(F.col("occurred_end"))
    out = documents.withColumn("_range", dates.date_range(F.col("title"), F.col("origin"), F.col("content")))
    start = F.coalesce(stated, F.col("_range.start"))
    is_stated = F.col("occurred_at").isNotNull()
    end = F.coalesce(stated_end, F.when(is_stated, start).otherwise(F.col("_range.end")), start)
    source = F.when(is_stated | F.col("occurred_end").isNotNull(), "explicit").when(F.col("_range.start").isNotNull(), "inferred").otherwise("unknown")
    out = out.withColumns({"event_time_provenance": F.coalesce("event_time_provenance", source), "_start": start, "_end": end})
    return out.drop("occurred_at", "occurred_end", "_range").withColumnsRenamed({"_start": "occurred_at", "_end": "occurred_end"})


def source_id(kind: Column, origin: Column, object_hash: Column) -> Column:
    """An id that the same (kind, origin, body) always gets."""
    return F.substring(F.sha2(F.concat_ws("\u0000", kind, origin, object_hash), 256), 1, 32)


@dataclass
class Tables:
    sources: DataFrame
    objects: DataFrame
    chunks: DataFrame
    postings: DataFrame
    totals: DataFrame
    #: What an import added to the tables that only grow.
    added: dict[str, DataFrame] = field(default_factory=dict)


def empty(spark: SparkSession) -> Tables:
    make = lambda s: spark.createDataFrame([], s)
    return Tables(make(schema.SOURCES), make(schema.OBJECTS), make(schema.CHUNKS), make(schema.POSTINGS), spark.createDataFrame([(0, 0)], schema.TOTALS))


def refused(documents: DataFrame) -> DataFrame:
    """(origin, title, code): documents whose stated dates are no real dates, which an import leaves out."""
    return documents.filter(~_real_dates()).select("origin", "title", F.lit("INVALID_DATE").alias("code"))


def _real_dates() -> Column:
    stated = F.array_compact(F.array("occurred_at", "occurred_end"))
    return (F.size(stated) == 0) | F.forall(dates.normalize_each(stated), lambda d: d.isNotNull())


def new_objects(documents: DataFrame, objects: DataFrame, now: datetime) -> DataFrame:
    """Bodies that the archive does not hold yet, once each."""
    fresh = documents.groupBy("object_hash").agg(F.first("content").alias("content")).withColumnRenamed("object_hash", "hash")
    return fresh.join(objects.select("hash"), "hash", "left_anti").withColumn("created_at", F.lit(now))


def passages(objects: DataFrame) -> DataFrame:
    """The passages of bodies with their dates: the deepest heading that has one, else the beginning."""
    rows = chunking.chunk_rows(objects)
    by_heading = dates.infer_each(F.reverse("heading_path"))
    date = F.coalesce(F.get(F.filter(by_heading, lambda d: d.isNotNull()), F.lit(0)), dates.infer_date(F.substring("content", 1, 240)))
    identity = F.concat_ws("-", F.substring("hash", 1, 32), F.col("ordinal").cast("string"))
    return rows.select(identity.alias("id"), F.col("hash").alias("object_hash"), "ordinal", "start_line", "end_line", "content", "heading_path", date.alias("occurred_at"))


def version_key() -> Column:
    """What versions of one thing share: its id at its connection, else kind and origin."""
    return F.when(
        F.col("external_id").isNotNull() & F.col("connection_id").isNotNull(), F.concat_ws("\u0000", F.lit("x"), "connection_id", "external_id")
    ).otherwise(F.concat_ws("\u0000", F.lit("o"), "kind", "origin"))


def import_documents(tables: Tables, documents: DataFrame, now: datetime | None = None) -> Tables:
    """The archive after importing ``documents`` (schema.DOCUMENTS).

    Empty bodies are left out, and so are documents whose stated dates are not
    real (see ``refused``).  Times of publication and change are kept as given;
    ``timestamps.normalize_times`` brings them to one form.  A body is stored
    once, whatever its sources.  A source known by (kind, origin, body) is
    revived and keeps what the document does not state, its title included; a
    new body supersedes other versions.
    """
    now = now or datetime.now(timezone.utc)
    stated = ["purpose", "authorship", "content_scope", "event_time_provenance"]
    docs = documents.withColumns({"content": text.body_text(F.col("content")), **{f"_stated_{c}": F.col(c) for c in stated}})
    docs = docs.filter((F.col("content") != "") & _real_dates()).withColumn("object_hash", F.sha2("content", 256))
    docs = with_attribution(with_event_time(docs)).withColumn("id", source_id(F.col("kind"), F.col("origin"), F.col("object_hash")))
    docs = docs.withColumn("observed_at", F.coalesce("observed_at", F.lit(now)))
    last = Window.partitionBy("id").orderBy(F.desc("observed_at"), F.desc("title"))
    docs = docs.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    # Three tables are made of the new bodies.
    added = cut_lineage(new_objects(docs, tables.objects, now))
    chunks = cut_lineage(passages(added))
    words = cut_lineage(index.postings(chunks))
    kept = ["occurred_at", "occurred_end", "published_at", "modified_at", "author", "speaker", "subject", "external_id", "connection_id"]
    new = docs.select(
        "id", "kind", "origin", "title", "object_hash", "original_path", "observed_at", *kept, *stated, *[f"_stated_{c}" for c in stated]
    ).alias("n")
    old = tables.sources.withColumn("is_current", F.col("is_current").cast("boolean")).alias("o")
    both = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    seen, known = F.col("n.id").isNotNull(), F.col("o.id").isNotNull()
    columns = {c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) for c in ("id", "kind", "origin", "original_path", "title", "object_hash")}
    columns |= {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in [*kept, "observed_at"]}
    columns |= {c: F.when(known, F.coalesce(F.col(f"n._stated_{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"n.{c}")) for c in stated}
    columns |= {
        "imported_at": F.coalesce("o.imported_at", F.lit(now)),
        "deleted_at": F.when(~seen, F.col("o.deleted_at")),
        "is_current": F.when(seen, True).otherwise(F.col("o.is_current")),
        "superseded_at": F.when(~seen, F.col("o.superseded_at")),
        "_seen": seen,
    }
    merged = both.select(*[c.alias(name) for name, c in columns.items()]).withColumn("_key", version_key())
    # Of the versions that arrive together, only the one observed last stays current.
    newest = Window.partitionBy("_key").orderBy(F.desc("_seen"), F.desc("observed_at"), F.desc("id"))
    merged = merged.withColumns({"_n": F.row_number().over(newest), "_touched": F.max("_seen").over(Window.partitionBy("_key"))})
    closed = F.col("_touched") & (F.col("_n") > 1) & F.col("is_current")
    merged = merged.withColumns({"superseded_at": F.when(closed, F.lit(now)).otherwise(F.col("superseded_at")), "is_current": F.col("is_current") & ~closed})
    names = [f.split()[0] for f in schema.SOURCES.split(", ")]
    return Tables(
        merged.select(*names),
        tables.objects.unionByName(added),
        tables.chunks.unionByName(chunks),
        tables.postings.unionByName(words),
        index.added_totals(tables.totals, index.totals(words)),
        {"objects": added, "chunks": chunks, "postings": words},
    )


def remove(sources: DataFrame, source: str | Column, now: datetime | None = None) -> DataFrame:
    """The source (or those of a condition) marked as removed; bodies and versions stay."""
    hit = (source if isinstance(source, Column) else F.col("id") == source) & F.col("deleted_at").isNull()
    return sources.withColumn("deleted_at", F.when(hit, F.lit(now or datetime.now(timezone.utc))).otherwise(F.col("deleted_at")))


def mark(sources: DataFrame, source: str | Column, purpose: str, authorship: str | None = None, scope: str | None = None) -> DataFrame:
    """Purpose and attribution corrected by hand; what is not given stays."""
    schema.check("purpose", purpose, schema.PURPOSES)
    schema.check("authorship", authorship, schema.AUTHORSHIPS)
    schema.check("scope", scope, schema.SCOPES)
    hit = (source if isinstance(source, Column) else F.col("id") == source) & F.col("deleted_at").isNull()
    author = F.lit(authorship) if authorship else F.col("authorship")
    subject = F.when((F.lit(scope) == "personal") & (author == "user"), "user").when(F.lit(scope).isin("sourced", "fictional"), None).otherwise(F.col("subject"))
    changes = {"purpose": F.lit(purpose), "authorship": author, "content_scope": F.lit(scope) if scope else F.col("content_scope"), "subject": subject}
    return sources.withColumns({c: F.when(hit, value).otherwise(F.col(c)) for c, value in changes.items()})


def memory_documents(entries: DataFrame) -> DataFrame:
    """Documents of (title, content, occurred_at, context); entries without title, text or real date are left out."""
    title, context = text.tidy(F.col("title")), F.nullif(text.body_text(F.col("context")), F.lit(""))
    shaped = entries.select(title.alias("title"), text.body_text(F.col("content")).alias("body"), dates.normalize_date(F.col("occurred_at")).alias("occurred_at"), context.alias("context"))
    shaped = shaped.filter((F.length("title") <= 120) & (F.length("body").between(1, 100_000)) & F.col("occurred_at").isNotNull())
    rendered = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("## "), "occurred_at", F.lit(f" · {MEMORY_TITLE}")), "body", F.when(F.col("context").isNotNull(), f"## {CONTEXT_TITLE}"), "context"
    )
    stable = F.substring(F.sha2(F.concat_ws("\u0000", "occurred_at", "title", rendered), 256), 1, 24)
    user = F.lit("user")
    fields = {
        "kind": F.lit("text"), "origin": F.concat(F.lit("remembered:"), "occurred_at", F.lit(":"), stable), "content": rendered, "purpose": F.lit("memory"),
        "authorship": F.when(F.col("context").isNotNull(), "mixed").otherwise("user"), "content_scope": F.lit("personal"), "author": user, "speaker": user, "subject": user,
        "occurred_end": F.col("occurred_at"),
    }
    return conform(shaped.withColumns(fields).drop("body", "context"))


def conform(documents: DataFrame) -> DataFrame:
    """The columns of schema.DOCUMENTS, NULL where ``documents`` has none."""
    wanted = [f.split() for f in schema.DOCUMENTS.split(", ")]
    return documents.select(*[(F.col(n) if n in documents.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def list_sources(sources: DataFrame) -> DataFrame:
    return live(sources).orderBy(F.desc("imported_at"), "id")


def read_range(sources: DataFrame, objects: DataFrame, start: int = 1, end: int = 200) -> DataFrame:
    """(id, title, content, start_line, end_line, total_lines) of every source not removed, superseded ones included; lines clamped."""
    bodies = objects.groupBy("hash").agg(F.min("content").alias("body"))
    joined = sources.filter(F.col("deleted_at").isNull()).join(bodies, F.col("object_hash") == F.col("hash"))
    lines = F.split("body", "\n")
    total = F.size(lines)
    first = F.least(F.lit(max(1, start)), total)
    last = F.least(F.greatest(F.lit(end), first), total)
    return joined.select("id", "title", F.array_join(F.slice(lines, first, last - first + 1), "\n").alias("content"), first.alias("start_line"), last.alias("end_line"), total.alias("total_lines"))


def overview(sources: DataFrame) -> DataFrame:
    """One row: memories, references, dated memories, and the first and last date of memories."""
    memory = F.col("purpose") == "memory"
    return live(sources).agg(
        F.count_if(memory).alias("memories"),
        F.count_if(F.col("purpose") == "reference").alias("reference_count"),
        F.count_if(memory & F.col("occurred_at").isNotNull()).alias("dated_memories"),
        F.min(F.when(memory, F.col("occurred_at"))).alias("earliest_memory"),
        F.max(F.when(memory, F.coalesce("occurred_end", "occurred_at"))).alias("latest_memory"),
    )


def card(summary: DataFrame) -> DataFrame:
    """One line of text for an overview."""
    period = F.when(F.col("earliest_memory").isNull(), "no dated memories").otherwise(F.format_string("from %s to %s", "earliest_memory", "latest_memory"))
    return summary.select(F.format_string("%d memories (%d dated, %s), %d references", "memories", "dated_memories", period, "reference_count").alias("card"))


def status(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: live sources, their bodies, and the passages of these."""
    current = live(sources)
    counts = current.agg(F.count(F.lit(1)).alias("sources"), F.count_distinct("object_hash").alias("objects"))
    used = chunks.join(current.select("object_hash"), "object_hash", "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    return counts.join(used)


def doctor(tables: Tables) -> DataFrame:
    """(problem, n): sources without body, bodies under a wrong hash, repeated ids, chunks without body, chunks that are not indexed."""
    # Ids are counted together, not joined: the index has many rows of few bytes, which Spark might take for a table to broadcast.
    ids = tables.chunks.select("id", F.lit(1).alias("rows")).unionAll(tables.postings.select("chunk_id", F.lit(0)))
    found = [
        ("source_without_object", tables.sources.join(tables.objects, F.col("object_hash") == F.col("hash"), "left_anti")),
        ("wrong_hash", tables.objects.filter(F.sha2("content", 256) != F.col("hash"))),
        ("repeated_source", tables.sources.groupBy("id").count().filter("count > 1")),
        ("chunk_without_object", tables.chunks.join(tables.objects, F.col("object_hash") == F.col("hash"), "left_anti")),
    ]
    rows = [df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n")) for name, df in found]
    alone = ids.groupBy("id").agg(F.sum("rows").alias("rows"), F.min("rows").alias("least")).filter("least = 1")
    rows.append(alone.agg(F.lit("chunk_not_indexed").alias("problem"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def export_rows(sources: DataFrame, objects: DataFrame) -> DataFrame:
    """Live sources with their bodies, by time of import."""
    bodies = objects.groupBy("hash").agg(F.min("content").alias("content"))
    return live(sources).join(bodies, F.col("object_hash") == F.col("hash")).drop("hash").orderBy("imported_at", "id")


def upgrade(old: DataFrame) -> DataFrame:
    """Sources of an older layout with every column of the current one filled."""
    wanted = [f.split() for f in schema.SOURCES.split(", ")]
    out = old.select(*[(F.col(n) if n in old.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])
    chat = F.col("kind") == "chat"
    out = out.withColumns(
        {
            "purpose": F.coalesce("purpose", F.when(chat, "memory").otherwise("reference")),
            "authorship": F.coalesce("authorship", F.when(chat, "mixed").otherwise("unknown")),
            "occurred_end": F.coalesce("occurred_end", "occurred_at"),
            "observed_at": F.coalesce("observed_at", "imported_at"),
            "is_current": F.coalesce("is_current", F.lit(True)),
        }
    )
    own = (F.col("purpose") == "memory") & (F.col("authorship") == "user")
    return out.withColumns(
        {
            "event_time_provenance": F.coalesce("event_time_provenance", F.when(F.col("occurred_at").isNotNull(), "inferred").otherwise("unknown")),
            "content_scope": F.coalesce("content_scope", F.when(own, "personal").otherwise("unknown")),
            "author": F.coalesce("author", F.when(F.col("authorship") == "user", "user")),
            "subject": F.coalesce("subject", F.when(own, "user")),
        }
    )


class Files:
    """The few small files of an archive, through the file system of its folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.path(name)):
            return None
        stream = self.system.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, words: str) -> None:
        """Written beside and then renamed, so that a reader finds the old or the new file."""
        draft = self.path(f"{name}.new")
        stream = self.system.create(draft, True)
        try:
            stream.write(bytearray(words.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.system.getConf())
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, overwrite)
        context.rename(draft, self.path(name), options)

    def folders(self) -> list[str]:
        return [s.getPath().getName() for s in self.system.listStatus(self.root) if s.isDirectory()]

    def drop(self, name: str) -> None:
        self.system.delete(self.path(name), True)


class Archive:
    """An archive in a folder that all executors share; a pointer file names the parts of every table.

    There is one writer at a time; readers keep the parts that they opened.
    """

    NAMES = ("sources", "objects", "chunks", "postings", "totals")
    #: Tables beside those of ``Tables``.
    LEDGERS = {"jobs": schema.JOBS, "connections": schema.CONNECTIONS}
    #: Parts of one table from which they are written together.
    MOST_PARTS = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = Files(spark, path)

    def _parts(self) -> dict[str, list[str]]:
        words = self.files.read("current.json")
        return json.loads(words)["tables"] if words else {}

    def exists(self) -> bool:
        return bool(self._parts())

    def _read(self, parts: dict[str, list[str]], name: str, columns: str) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in parts.get(name, ())]
        if not paths:
            return self.spark.createDataFrame([], columns)
        names = [c.split()[0] for c in columns.split(", ")]
        return self.spark.read.parquet(*paths).select(*names)

    def tables(self) -> Tables:
        parts = self._parts()
        if not parts:
            return empty(self.spark)
        kinds = (schema.SOURCES, schema.OBJECTS, schema.CHUNKS, schema.POSTINGS, schema.TOTALS)
        return Tables(*[self._read(parts, name, kind) for name, kind in zip(self.NAMES, kinds)])

    def ledger(self, name: str) -> DataFrame:
        return self._read(self._parts(), name, self.LEDGERS[name])

    def write(self, replaced: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> None:
        """Writes whole tables and additions to tables; all others keep their parts."""
        at = f"part-{uuid.uuid4().hex}"
        parts = self._parts()
        for name, df in (replaced | (added or {})).items():
            writer = df.write
            if name == "postings":
                # A search reads only the row groups that may hold its buckets and terms.
                writer = df.repartition("bucket").sortWithinPartitions("bucket", "token").write
            writer.parquet(f"{self.path}/{at}/{name}")
            parts[name] = [f"{at}/{name}"] if name in replaced else [*parts.get(name, ()), f"{at}/{name}"]
        self.files.write("current.json", json.dumps({"version": schema.VERSION, "tables": parts}))
        crowded = [name for name in parts if len(parts[name]) > self.MOST_PARTS]
        if crowded:
            kinds = dict(zip(self.NAMES, (schema.SOURCES, schema.OBJECTS, schema.CHUNKS, schema.POSTINGS, schema.TOTALS))) | self.LEDGERS
            self.write({name: self._read(parts, name, kinds[name]) for name in crowded})

    def save(self, tables: Tables) -> None:
        """All tables anew."""
        self.write({name: getattr(tables, name) for name in self.NAMES})

    def vacuum(self) -> list[str]:
        """Deletes the folders of parts that the pointer no longer names; to be called when nobody reads them."""
        used = {p.split("/")[0] for paths in self._parts().values() for p in paths}
        old = [name for name in self.files.folders() if name.startswith("part-") and name not in used]
        for name in old:
            self.files.drop(name)
        return old

    def add(self, documents: DataFrame, now: datetime | None = None) -> None:
        done = import_documents(self.tables(), conform(documents), now)
        if self.exists():
            self.write({"sources": done.sources, "totals": done.totals}, done.added)
        else:
            self.save(done)

    def remember(self, title: str, content: str, occurred_at: str, context: str | None = None) -> str:
        """Keeps one entry; returns its origin, which is the same for the same entry."""
        rows = self.spark.createDataFrame([(title, content, occurred_at, context)], "title string, content string, occurred_at string, context string")
        documents = memory_documents(rows)
        found = documents.select("origin").head()
        if found is None:
            raise ArchiveError("INVALID_ENTRY", "a title of at most 120 characters, a text and a real date are needed")
        self.add(documents)
        return found.origin

    def remove(self, source: str) -> None:
        sources = self.tables().sources
        self._known(sources, source)
        self.write({"sources": remove(sources, source)})

    def mark(self, source: str, purpose: str, authorship: str | None = None, scope: str | None = None) -> None:
        sources = self.tables().sources
        self._known(sources, source)
        self.write({"sources": mark(sources, source, purpose, authorship, scope)})

    def upgrade(self, now: datetime | None = None) -> None:
        """Brings the archive to the current layout: sources filled, all bodies cut into passages and indexed anew."""
        tables = self.tables()
        chunks = cut_lineage(passages(tables.objects))
        words = cut_lineage(index.postings(chunks))
        self.write({"sources": upgrade(tables.sources), "chunks": chunks, "postings": words, "totals": index.totals(words)})

    def _known(self, sources: DataFrame, source: str) -> None:
        if sources.filter((F.col("id") == source) & F.col("deleted_at").isNull()).isEmpty():
            raise ArchiveError("SOURCE_NOT_FOUND", f"no source {source}")
