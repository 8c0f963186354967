"""Files, folders, archives and chat exports as rows of documents."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import dates, html, text, urls

#: Limits of one import.
ENTRY_BYTES, TOTAL_BYTES, MAX_ENTRIES = 10 * 1024 * 1024, 2 * 1024**3, 20_000
IGNORED_FOLDERS = (".git", "node_modules", "dist", ".next", "coverage")

ENTRY_SCHEMA = "archive string, entry_no int, name string, size bigint, modified_at string, data binary, skip_code string"


def list_files(spark: SparkSession, path: str, archives: bool = False) -> DataFrame:
    """(path, modified_at, length, content) of the supported files of a folder or one file, ignored folders left out; or of its ZIP archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ignored = r"/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")/"
    wanted = F.lower("path").endswith(".zip") if archives else urls.is_supported_file(F.col("path"))
    return files.filter(wanted & ~F.col("path").rlike(ignored)).select("path", F.col("modificationTime").alias("modified_at"), "length", "content")


def limited(files: DataFrame, max_files: int = MAX_ENTRIES, max_bytes: int = ENTRY_BYTES) -> DataFrame:
    """Adds skip_code: TOO_MANY_ENTRIES beyond the first ``max_files`` by path, ENTRY_TOO_LARGE, else NULL."""
    # Only paths are ordered, and one of them is brought back: the first that is too many.
    beyond = files.select("path").orderBy("path").offset(max_files).limit(1).collect()
    many = F.col("path") >= beyond[0].path if beyond else F.lit(False)
    return files.withColumn("skip_code", F.when(many, "TOO_MANY_ENTRIES").when(F.col("length") > max_bytes, "ENTRY_TOO_LARGE"))


def entry_problem(name: Column, flags: Column, mode: Column) -> Column:
    """Why an archive's entry must not be read, NULL if it may: UNSAFE_PATH, ENCRYPTED_ENTRY or SYMLINK_ENTRY."""
    slashed = F.translate(name, "\\", "/")
    unsafe = slashed.startswith("/") | slashed.rlike(r"^[A-Za-z]:") | slashed.rlike(r"(?:^|/)\.\.(?:/|$)")
    link = F.shiftright(mode, 16).bitwiseAND(0o170000) == 0o120000
    return F.when(unsafe, "UNSAFE_PATH").when(flags.bitwiseAND(1) == 1, "ENCRYPTED_ENTRY").when(link, "SYMLINK_ENTRY")


def running_total(entries: DataFrame, max_total: int = TOTAL_BYTES) -> DataFrame:
    """TOTAL_TOO_LARGE for entries of an archive from which the sizes add up to more; skipped entries add nothing."""
    order = Window.partitionBy("archive").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("skip_code").isNull(), F.col("size")).otherwise(0)).over(order)
    return entries.withColumn("total", total).withColumn("skip_code", F.coalesce("skip_code", F.when(F.col("total") > max_total, "TOTAL_TOO_LARGE")))


def zip_problem(info: zipfile.ZipInfo) -> str | None:
    name = info.filename.replace("\\", "/")
    if name.startswith("/") or (len(name) > 1 and name[1] == ":" and name[0].isalpha()) or ".." in name.split("/"):
        return "UNSAFE_PATH"
    if info.flag_bits & 1:
        return "ENCRYPTED_ENTRY"
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "SYMLINK_ENTRY"
    return None


def read_zip(data: bytes, max_entries: int = MAX_ENTRIES, max_bytes: int = ENTRY_BYTES, max_total: int = TOTAL_BYTES):
    """(entry_no, name, size, modified_at, data, skip_code) of the entries, one in memory at a time, nothing written to disk."""
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for n, info in enumerate(i for i in archive.infolist() if not i.is_dir()):
            if n >= max_entries:
                yield n, info.filename, info.file_size, None, None, "TOO_MANY_ENTRIES"
                return
            code = zip_problem(info)
            if not code and posixpath.splitext(info.filename)[1].lower().lstrip(".") not in urls.SUPPORTED:
                code = "UNSUPPORTED_TYPE"
            if not code and info.file_size > max_bytes:
                code = "ENTRY_TOO_LARGE"
            if not code and total + info.file_size > max_total:
                code = "TOTAL_TOO_LARGE"
            body = None
            if not code:
                # What a header says of its size is not trusted.
                with archive.open(info) as stream:
                    body = stream.read(max_bytes + 1)
                total += len(body)
                code = "ENTRY_TOO_LARGE" if len(body) > max_bytes else "EMPTY_CONTENT" if not body.strip() else None
            moment = "{:04}-{:02}-{:02}T{:02}:{:02}:{:02}.000Z".format(*info.date_time)
            yield n, info.filename, info.file_size, moment, None if code else body, code


def zip_entries(files: DataFrame) -> DataFrame:
    """The entries of every archive in (path, content)."""

    def rows(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for entry in read_zip(data):
                        yield _entry_batch([(path, *entry)])
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError):
                    yield _entry_batch([(path, 0, "", 0, None, None, "BAD_ARCHIVE")])

    return files.select("path", "content").mapInArrow(rows, ENTRY_SCHEMA)


def _entry_batch(rows):
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["archive", "entry_no", "name", "size", "modified_at", "data", "skip_code"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def _chat_documents(path: str, conversations: list) -> list[dict]:
    """One document per conversation of a chat export."""
    found = []
    name = posixpath.basename(path)
    for item in conversations:
        if not isinstance(item, dict) or not isinstance(item.get("mapping"), dict):
            continue
        turns = []
        for entry in item["mapping"].values():
            message = entry.get("message") if isinstance(entry, dict) else None
            if not isinstance(message, dict):
                continue
            parts = (message.get("content") or {}).get("parts") or []
            words = "\n".join(p if isinstance(p, str) else str(p.get("text") or "") if isinstance(p, dict) else "" for p in parts).strip()
            if words:
                at = message.get("create_time")
                turns.append((at if isinstance(at, (int, float)) else 0, str(entry.get("id") or ""), (message.get("author") or {}).get("role") or "unknown", words))
        if not turns:
            continue
        number = len(found) + 1
        turns.sort(key=lambda t: t[:2])
        days = [_day(t[0]) for t in turns if t[0] > 0]
        title = item.get("title") or f"{name} {number}"
        body = [f"# {title}", *[f"## {_day(t[0]) or 'undated'} · {t[2]}\n{t[3]}" for t in turns]]
        found.append(
            {
                "kind": "chat", "title": title, "content": "\n\n".join(body), "origin": f"{path}#conversation-{number}", "purpose": "memory", "authorship": "mixed",
                "occurred_at": days[0] if days else None, "occurred_end": days[-1] if days else None, "event_time_provenance": "platform" if days else None,
            }
        )
    return found


def _day(seconds: float) -> str | None:
    from datetime import datetime, timedelta

    return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).date().isoformat() if seconds > 0 else None


def documents_of(path: str, data: bytes) -> list[dict]:
    """The documents in one file, by its extension."""
    words = data.decode("utf-8", "replace").lstrip("﻿").replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n").strip()
    suffix = posixpath.splitext(path)[1].lower()
    name = posixpath.splitext(posixpath.basename(path))[0]
    plain = {"kind": "file", "title": posixpath.basename(path), "content": words, "origin": path}
    if suffix in (".html", ".htm"):
        title, content = html.extract(words)
        return [plain | {"title": title, "content": content}]
    if suffix == ".json":
        try:
            value = json.loads(words)
        except (ValueError, RecursionError):
            return [plain]
        if isinstance(value, list) and (chats := _chat_documents(path, value)):
            return chats
        return [plain | {"content": json.dumps(value, ensure_ascii=False, indent=2)}]
    if suffix in (".md", ".markdown"):
        heading = next((line[2:].strip() for line in words.split("\n") if line.startswith("# ") and line[2:].strip()), None)
        return [plain | {"title": heading or name}]
    return [plain | {"title": name}]


def without_root(name: Column) -> Column:
    """The path of an archive's entry below the archive's one root folder."""
    return F.regexp_replace(F.translate(name, "\\", "/"), r"^[^/]*/(?=.)", "")


def entry_documents(entries: DataFrame, origin: Column | None = None) -> DataFrame:
    """Documents of an archive's entries (archive, name, modified_at, data, skip_code), read by their extension like files.

    ``origin`` names an entry, by default ``archive#name``; entries with a skip
    code are left out.
    """
    named = F.concat("archive", F.lit("#"), F.col("name")) if origin is None else origin
    return read_documents(entries.filter("skip_code is null").select(named.alias("path"), "modified_at", F.col("data").alias("content")))


FIELDS = ["kind", "title", "content", "origin", "original_path", "purpose", "authorship", "occurred_at", "occurred_end", "event_time_provenance", "modified_at"]
DOCUMENT_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def read_documents(files: DataFrame) -> DataFrame:
    """Documents from (path, modified_at, content): texts, pages, JSON and chat exports."""

    def rows(batches):
        for batch in batches:
            for path, moment, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = [{"original_path": path, "modified_at": moment} | d for d in documents_of(path, data or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([d.get(f) for d in found], pa.string()) for f in FIELDS], FIELDS)

    moment = F.col("modified_at").cast("string")
    documents = files.select("path", moment.alias("modified_at"), "content").mapInArrow(rows, DOCUMENT_SCHEMA).filter("trim(content) != ''")
    # Texts that state no time of their own may carry it in title or name.
    named = dates.infer_first(F.col("title"), F.element_at(F.split("original_path", "/"), -1))
    return documents.withColumns(
        {
            "event_time_provenance": F.coalesce("event_time_provenance", F.when(F.col("occurred_at").isNull() & named.isNotNull(), "filename")),
            "occurred_at": F.coalesce("occurred_at", named),
        }
    )


def chat_table(conversations: DataFrame) -> DataFrame:
    """The same rendering of chats for lines that are rows: (conv_id, title, node_id, role, text, created_at) to (conv_id, title, content, occurred_at, occurred_end)."""
    # Lines with a clock of another unit stay, in their place and with their day.
    shown = conversations.filter(F.trim("text") != "").withColumn("created_at", dates.clock_seconds(F.col("created_at")))
    day = F.coalesce(dates.epoch_date(F.col("created_at")), F.lit("undated"))
    turn = F.struct(F.coalesce("created_at", F.lit(0.0)).alias("at"), "node_id", F.concat(F.lit("## "), day, F.lit(" · "), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.col("text")).alias("words"))
    grouped = shown.groupBy("conv_id").agg(
        F.min("title").alias("title"),
        F.array_sort(F.collect_list(turn)).alias("turns"),
        F.min(F.when(F.col("created_at") > 0, F.col("created_at"))).alias("first"),
        F.max(F.when(F.col("created_at") > 0, F.col("created_at"))).alias("last"),
    )
    content = F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("untitled"))), F.array_join("turns.words", "\n\n"))
    return grouped.select("conv_id", "title", content.alias("content"), dates.epoch_date(F.col("first")).alias("occurred_at"), dates.epoch_date(F.col("last")).alias("occurred_end"))
