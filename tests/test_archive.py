import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import chunking, dates, html, text, urls
from lodestrata.operators import connections, jobs, search, store
from lodestrata.plans import archive as plans
from lodestrata.session import cut_lineage
from lodestrata.sources import readers, web

NOW = datetime(2026, 1, 1, tzinfo=timezone.utc)


def documents(spark, rows):
    names = ["kind", "origin", "title", "content", "purpose", "authorship", "occurred_at", "content_scope", "external_id", "connection_id"]
    full = [tuple(r.get(n) for n in names) for r in rows]
    return store.conform(spark.createDataFrame(full, ", ".join(f"{n} string" for n in names)))


def added(spark, rows, tables=None, now=NOW):
    new = store.import_documents(tables or store.empty(spark), documents(spark, rows), now)
    return store.Tables(*[cut_lineage(getattr(new, n)) for n in store.Archive.NAMES])


def note(origin, content, **fields):
    return {"kind": "file", "origin": origin, "title": fields.pop("title", origin), "content": content} | fields


def values(spark, column, words):
    rows = spark.createDataFrame(list(enumerate(words)), "n int, x string").coalesce(1)
    return [r.y for r in rows.select("n", column(F.col("x")).alias("y")).orderBy("n").collect()]


def value(spark, column, words):
    return values(spark, column, [words])[0]


def test_tokens(spark):
    got = values(spark, text.index_tokens, ["工作焦虑 TypeScript 2026", "工作 工作 ＯＲ 字", "", None])
    assert got == [["工作", "作焦", "焦虑", "typescript", "2026"], ["工作", "字", "or"], [], None]
    assert text.tokens_of("工作 工作 ＯＲ 字") == ["工作", "字", "or"]
    assert set(text.meaningful_terms("OpenAI file search 怎么检索吗")) == {"openai", "file", "search", "检索"}
    assert text.meaningful_terms("what is the") == []


def test_dates(spark):
    assert values(spark, dates.normalize_date, ["2026-09-15", "2026-09", "2026", "09/15", "2026-02-30", None, "２０２６-０９", "2026-09-15 10:00"]) == ["2026-09-15", "2026-09", "2026", None, None, None, "2026-09", "2026-09-15"]
    assert values(spark, dates.infer_date, ["on 2024/3/2.", "2025年11月", "no 20240302 date", "2023-02-30 then 2023-03", "", "２０２４年３月", "２０２４-０１-１２", "2024⽉ 2024年㋂"]) == ["2024-03-02", "2025-11", None, "2023-02", None, "2024-03", "2024-01-12", "2024-03"]
    span = value(spark, dates.date_range, "2024-05-01\nx\n2023年4月\n2025")
    assert (span.start, span.end) == ("2023-04", "2024-05-01")


def test_chunks():
    found = chunking.chunk("first\n\nsecond", 8)
    assert [(c.start, c.end, c.text) for c in found] == [(1, 1, "first"), (3, 3, "second")]
    found = chunking.chunk("# A\n\none\n\n## A\n## B\ntwo\n# C\nthree")
    assert [(c.text, c.path) for c in found] == [("# A\n\none\n\n## A", ("A",)), ("## B\n\ntwo", ("A", "B")), ("# C\n\nthree", ("C",))]
    long = "句子。" * 1000
    pieces = chunking.chunk(long)
    assert "".join(c.text for c in pieces) == long and max(map(len, (c.text for c in pieces))) <= 1200
    astral = "😀" * 1500
    assert sum(chunking.units(c.text) for c in chunking.chunk(astral)) == 3000 and all(chunking.units(c.text) <= 1200 for c in chunking.chunk(astral))
    assert chunking.chunk(None) == [] and chunking.chunk(" \n\r\n") == []


def test_same_body_two_origins(spark):
    tables = added(spark, [note("a", "same body\r\n"), note("b", "same body")])
    row = store.status(tables.sources, tables.chunks).head()
    assert (row.sources, row.objects, row.chunks) == (2, 1, 1)
    assert all(r.n == 0 for r in store.doctor(tables).collect())


def test_doctor_counts_passages_without_index_rows(spark):
    tables = added(spark, [note("a", "some words"), note("b", "。。"), note("c", "more words")])
    tables.chunks = tables.chunks.unionAll(tables.chunks.filter("content = '。。'"))
    assert {r.problem: r.n for r in store.doctor(tables).collect() if r.n} == {"chunk_not_indexed": 2}
    plan = store.doctor(tables)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Join \[id#\d+\], \[chunk_id#", plan)


def test_doctor_query_stores_no_index(spark, monkeypatch):
    monkeypatch.setattr(plans, "_INDEXES", {})
    monkeypatch.setattr(plans, "cut_lineage", lambda df: pytest.fail("the index is stored"))
    report = plans.doctor(spark, "/root/testdata/sf0.001")
    assert {r.problem: r.n for r in report.collect()}.keys() == {"source_without_object", "wrong_hash", "repeated_source", "chunk_without_object", "chunk_not_indexed"}


def test_repeat_import_keeps_what_was_marked(spark):
    tables = added(spark, [note("a", "body", title="first title")])
    source = tables.sources.head().id
    tables.sources = store.mark(store.remove(tables.sources, "no such"), source, "memory", "user", "personal")
    tables.sources = store.remove(tables.sources, source, NOW)
    assert store.live(tables.sources).isEmpty()
    again = added(spark, [note("a", "body", title="second title")], tables)
    row = again.sources.collect()
    assert len(row) == 1 and (row[0].purpose, row[0].content_scope, row[0].subject, row[0].title, row[0].deleted_at) == ("memory", "personal", "user", "first title", None)
    assert again.objects.count() == again.chunks.count() == 1


def test_new_body_supersedes(spark):
    first = added(spark, [note("a", "old words", external_id="1", connection_id="c"), note("z", "other")])
    second = added(spark, [note("moved", "new words", external_id="1", connection_id="c")], first)
    state = {r.origin: (r.is_current, r.superseded_at is None) for r in second.sources.collect()}
    assert state == {"a": (False, False), "moved": (True, True), "z": (True, True)}
    assert [r.origin for r in search.search(second, "words").collect()] == ["moved"]
    assert {r.content for r in store.read_range(second.sources, second.objects).collect()} == {"old words", "new words", "other"}


def test_search_rules(spark):
    tables = added(
        spark,
        [
            note("t", "nothing here", title="Alpha Beta guide"), note("b", "alpha beta gamma in the body"), note("x", "É upper case"), note("c", "字"), note("d", "alpha only"),
            *[note("many", f"# h{n}\n\nalpha beta {n}\n" + "\n".join(f"# s{i}\n\nalpha beta {i}" for i in range(5))) for n in range(1)],
        ],
    )
    found = {r.origin: r for r in search.search(tables, "alpha beta", 30).collect()}
    assert found["t"].exact and found["t"].coverage == 1.0 and "d" not in found
    # A title that names the subject is no evidence for the rest of the question.
    assert "t" not in {r.origin for r in search.search(tables, "alpha beta gamma").collect()}
    assert [r.origin for r in search.search(tables, "字").collect()] == ["c"]
    assert search.search(tables, "what is the").collect() == [] and search.query(tables, ["", "  "]).collect() == []
    assert sum(r.origin == "many" for r in search.query(tables, ["alpha beta"], 30).collect()) == 2
    fused = search.query(tables, ["Alpha  BETA", "gamma", "alpha beta"], 30).collect()
    assert {r.origin: r.matched_queries for r in fused}["b"] == ["alpha beta", "gamma"]


def test_recall_modes(spark):
    mine = {"purpose": "memory", "authorship": "user"}
    tables = added(
        spark,
        [
            note("1", "rent worries", occurred_at="2022-01-01", **mine), note("2", "rent again", occurred_at="2023", **mine), note("3", "rent", occurred_at="2024-05", **mine),
            note("4", "rent in a novel", content_scope="fictional", **mine), note("5", "rent said somebody", purpose="memory"), note("6", "rent of others"),
        ],
    )
    change = search.recall(tables, ["rent"], "change")
    assert [r.origin for r in change.hits.collect()] == ["1", "2", "3", "5"]
    assert change.summary.head().sufficient and change.summary.head().claimable_periods == 3
    assert search.recall(tables, ["rent"], "pattern").summary.head().sufficient
    assert len(search.recall(tables, ["rent"], "change", limit=2).hits.collect()) == 2
    assert [r.origin for r in search.recall(tables, ["rent again"], "quote").hits.collect()] == ["2"]
    nothing = search.recall(tables, ["no such thing"], "moment").summary.head()
    assert not nothing.sufficient and nothing.reason == "NOTHING_FOUND"
    only = added(spark, [note("5", "rent said somebody", purpose="memory")])
    assert search.recall(only, ["rent"], "moment").summary.head().reason == "NOT_PERSONAL"
    with pytest.raises(ValueError):
        search.recall(tables, ["rent"], "poem")


def test_archive_folder(spark, tmp_path):
    archive = store.Archive(spark, str(tmp_path / "space"))
    origin = archive.remember("A walk", "It rained.", "2024-01-12", None)
    assert archive.remember("A walk", "It rained.", "2024-01-12", None) == origin
    tables = archive.tables()
    assert tables.sources.count() == 1 and store.overview(tables.sources).head().earliest_memory == "2024-01-12"
    with pytest.raises(store.ArchiveError):
        archive.remember("x" * 121, "long title", "2024")
    with pytest.raises(store.ArchiveError):
        archive.remove("nobody")
    archive.remove(tables.sources.head().id)
    assert store.live(archive.tables().sources).isEmpty()


def test_files(spark, tmp_path):
    import json
    import zipfile

    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/skip.md").write_text("no")
    (tmp_path / "2024-03-02 walk.md").write_text("# Walk\r\n\r\nrain")
    (tmp_path / "page.html").write_text("<html><title>T</title><body><nav>menu</nav><main><h1>Head</h1><p>text<li>one</main></body></html>")
    (tmp_path / "bad.json").write_text("{no")
    (tmp_path / "photo.png").write_bytes(b"x")
    mapping = {"a": {"id": "a", "message": None}, "b": {"id": "b", "message": {"author": {"role": "user"}, "create_time": 1700000000, "content": {"parts": ["hi", {"text": "there"}]}}}}
    (tmp_path / "chat.json").write_text(json.dumps([{"title": "Chat", "mapping": mapping}]))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("notes/a.md", "# a")
        z.writestr("../up.md", "no")
        z.writestr("b.png", "no")
        z.writestr("empty.md", " ")
    files = readers.limited(readers.list_files(spark, str(tmp_path)))
    docs = {r.title: r for r in readers.read_documents(files.select("path", "modified_at", "content")).collect()}
    assert set(docs) == {"Walk", "Head", "bad.json", "Chat"} or set(docs) == {"Walk", "T", "bad.json", "Chat"}
    assert docs["Walk"].occurred_at == "2024-03-02" and docs["Walk"].event_time_provenance == "filename"
    assert docs["Chat"].content == "# Chat\n\n## 2023-11-14 · user\nhi\nthere" and docs["Chat"].kind == "chat"
    archives = spark.read.format("binaryFile").load(str(tmp_path / "x.zip"))
    entries = readers.zip_entries(archives)
    (inside,) = readers.entry_documents(entries).collect()
    assert inside.title == "a" and inside.origin.endswith("x.zip#notes/a.md")
    codes = {r.name: r.skip_code for r in entries.collect()}
    assert codes == {"notes/a.md": None, "../up.md": "UNSAFE_PATH", "b.png": "UNSUPPORTED_TYPE", "empty.md": "EMPTY_CONTENT"}


def test_html():
    title, content = html.extract("<title>Guide - Site</title><body><header>x</header><article class='markdown-body'><h1>Guide</h1><p>One <b>two</b></p><ul><li>a</li></ul><script>no</script></article><p>Sign in</p></body>")
    assert title == "Guide" and content == "# Guide\nOne two\n- a"
    assert html.extract("") == (html.UNTITLED, f"# {html.UNTITLED}") and html.extract(None)[0] == html.UNTITLED
    meta = html.metadata(html.parse("<meta name='author' content='A'><meta name='date' content='2024-01-01'><time datetime='2023'>"))
    assert meta == {"published_at": "2024-01-01", "modified_at": None, "author": "A"}
    deep = "<div>" * 20_000 + "x"
    assert html.extract(deep)[1].endswith("x")


def test_urls(spark):
    assert value(spark, urls.canonical_url, "HTTP://Example.COM:80#x") == "http://example.com/"
    expected = {"ftp://a.b/": "BAD_SCHEME", "http://u:p@a.b/": "CREDENTIALS", "http://a.b:8080/": "BAD_PORT", "http://localhost/": "LOCAL_HOST", "http://10.0.0.1/": "PRIVATE_ADDRESS", "http://[::1]/": "PRIVATE_ADDRESS", "nothing": "BAD_URL", "https://a.b/c?d": None}
    assert values(spark, urls.url_problem, list(expected)) == list(expected.values())


def test_sites(spark):
    links = spark.createDataFrame([("https://s.example/a/1", "https://s.example/a/2"), ("https://s.example/a/2", "https://s.example/a/3"), ("https://s.example/a/3", "https://s.example/a/4"), ("https://s.example/a/1", "https://s.example/b/1"), ("https://s.example/a/2", "https://s.example/a/1")], "src string, dst string")
    seeds = spark.createDataFrame([("https://s.example/a/1#top",)], "url string")
    assert {r.url[-1]: r.depth for r in web.reachable(seeds, links).collect()} == {"1": 0, "2": 1, "3": 2}


def test_redirects_and_listings(spark):
    pages = [("https://a.example/1", 301, "/2"), ("https://a.example/2", 302, "https://a.example/3"), ("https://a.example/3", 200, None), ("https://a.example/x", 301, "https://b.example/"), ("https://a.example/loop", 301, "/loop"), ("https://a.example/gone", 301, "/nowhere"), (None, 200, None)]
    got = {r.url[18:]: (r.final_url[18:], r.hops, r.skip_code) for r in web.follow_redirects(spark.createDataFrame(pages, "url string, status int, location string")).collect()}
    assert got == {"1": ("3", 2, None), "2": ("3", 1, None), "3": ("3", 0, None), "x": ("x", 0, "CROSS_ORIGIN_REDIRECT"), "loop": ("loop", 5, "TOO_MANY_REDIRECTS"), "gone": ("nowhere", 1, "NOT_FETCHED")}
    listed = spark.createDataFrame([("a.example", f"https://a.example/{n}.xml") for n in range(6)] + [("a.example", "https://b.example/x.xml")], "site string, url string")
    assert sorted((r.url[-5:], r.skip_code) for r in web.feeds_followed(listed).collect() if r.skip_code) == [("4.xml"[-5:], "TOO_MANY_FEEDS"), ("5.xml"[-5:], "TOO_MANY_FEEDS"), ("x.xml"[-5:], "CROSS_ORIGIN")]


def test_repository_entries_are_read_by_extension(spark):
    rows = [("r.zip", 0, "root-main/docs/a.md", 5, None, b"# Head\n\nwords", None), ("r.zip", 1, "root-main/p.html", 5, None, b"<title>T</title><main><p>text</p></main>", None), ("r.zip", 2, "root-main/x.png", 5, None, None, "UNSUPPORTED_TYPE")]
    docs = {d.origin: (d.title, d.original_path, d.purpose, d.authorship) for d in web.repository_documents(spark.createDataFrame(rows, readers.ENTRY_SCHEMA), "https://h/o/r", "main").collect()}
    assert docs == {"https://h/o/r/tree/main#docs/a.md": ("Head", "docs/a.md", "reference", "other"), "https://h/o/r/tree/main#p.html": ("T", "p.html", "reference", "other")}


def test_commands(spark, tmp_path):
    from lodestrata import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Walk\n\nalpha beta")
    space = str(tmp_path / "space")
    do = lambda *words: cli.run(spark, cli._parser().parse_args(["--space", space, *words]))
    entered = do("enter", str(tmp_path / "in"), "--authorship", "other")
    assert entered["connections"] == 1 and entered["syncs"][0]["state"] == "completed" and entered["overview"]["memories"] == 1
    job = do("sync-status")["job"]
    assert (job["imported"], job["unchanged"]) == (1, 0)
    assert [h["title"] for h in do("search", "alpha")["hits"]] == ["Walk"]
    (source,) = do("sources")["sources"]
    assert source["authorship"] == "other" and do("read", source["id"], "--start", "3")["content"] == "alpha beta"
    archive = store.Archive(spark, space)
    archive.remove(source["id"])
    before = set(archive.files.folders())
    assert archive.vacuum() and set(archive.files.folders()) < before and store.live(archive.tables().sources).isEmpty()
    with pytest.raises(store.ArchiveError):
        do("sync", "nobody")


def test_stated_dates_that_are_not_real_are_refused(spark):
    rows = [note("a", "x", occurred_at="2023-02-30"), note("b", "y", occurred_at="２０２３-０１-０２")]
    tables = added(spark, rows)
    assert [(r.origin, r.occurred_at) for r in tables.sources.collect()] == [("b", "2023-01-02")]
    assert [(r.origin, r.code) for r in store.refused(documents(spark, rows)).collect()] == [("a", "INVALID_DATE")]


def test_jobs(spark):
    ledger = spark.createDataFrame([], "job_id string, connection_id string, state string, error string, completed int, total int, imported int, unchanged int, skipped int, created_at timestamp, updated_at timestamp")
    for n, state in enumerate(["pending", "running", "completed"]):
        ledger = jobs.append(ledger, {"job_id": "j", "connection_id": "c", "state": state, "completed": n, "created_at": NOW, "updated_at": NOW})
        assert jobs.latest(ledger).head().state == state
    assert jobs.active(ledger).isEmpty()
    with pytest.raises(ValueError):
        jobs.append(ledger, {"job_id": "j", "state": "lost"})


def test_stream(spark, tmp_path):
    from lodestrata.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\n\nwords")
    archive = store.Archive(spark, str(tmp_path / "space"))
    ingest.follow(archive, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination(120)
    (tmp_path / "in/b.md").write_text("# B\n\nmore words")
    ingest.follow(archive, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.title for r in archive.tables().sources.collect()) == ["A", "B"]


def test_connections(spark):
    registry = spark.createDataFrame([], connections.SCHEMA)
    inputs = spark.createDataFrame([("https://GitHub.com/a/b/",), ("https://github.com/a/b",), ("notes",), (" ",), (None,)], "input string")
    once = cut_lineage(connections.connect(registry, inputs, NOW))
    assert {r.input: (r.kind, r.purpose, r.content_scope) for r in once.collect()} == {"https://github.com/a/b": ("github", "reference", "sourced"), "notes": ("local", "memory", "personal")}
    assert connections.connect(once, inputs, NOW).count() == 2


def test_job_runs_and_fails(spark, tmp_path):
    from lodestrata import schema

    archive = store.Archive(spark, str(tmp_path / "space"))
    ledger = jobs.run(archive, spark.createDataFrame([], schema.JOBS), "j1", "c", documents(spark, [note("a", "x"), note("b", "y")]), skipped=1)
    row = jobs.latest(ledger).head()
    assert (row.state, row.total, row.imported, row.unchanged, row.skipped) == ("completed", 3, 2, 0, 1)
    broken = documents(spark, [note("a", "x")]).withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    assert {r.job_id: r.state for r in jobs.latest(jobs.run(archive, ledger, "j2", "c", broken)).collect()} == {"j1": "completed", "j2": "failed"}


def test_page_documents_and_card(spark):
    pages = spark.createDataFrame([(1, "https://S.example/a#x", "<title>T</title><body><p>words</p></body>"), (2, "https://s.example/b", None)], "page_id bigint, url string, html string")
    docs = web.page_documents(pages, html.extract_pages(pages)).orderBy("origin").collect()
    assert [(d.origin, d.title, d.content) for d in docs] == [("https://s.example/a", "T", "# T\n\nwords"), ("https://s.example/b", html.UNTITLED, f"# {html.UNTITLED}")]
    tables = added(spark, [note("a", "x", purpose="memory", occurred_at="2024"), note("b", "y")])
    assert store.card(store.overview(tables.sources)).head().card == "1 memories (1 dated, from 2024 to 2024), 1 references"


def test_chats_keep_lines_of_every_clock(spark, tmp_path):
    from lodestrata.plans import archive

    line = "conv_id bigint, node_id string, role string, text string, created_at double"
    rows = [(1, "a", "user", "in ms", 1.7e12), (2, "a", "user", "late", 1.7e9 + 60), (2, "b", None, "early", 1.7e12), (2, "c", "user", "no clock", 1e15), (2, "d", "user", "lost", None)]
    spark.createDataFrame(rows, line).write.parquet(f"{tmp_path}/chat_lines.parquet")
    spark.createDataFrame([(1, "one"), (2, None)], "conv_id bigint, title string").write.parquet(f"{tmp_path}/chat_conversations.parquet")
    got = {r.conv_id: (r.occurred_at, r.occurred_end) for r in archive.chat_render(spark, str(tmp_path)).collect()}
    assert got == {1: ("2023-11-14", "2023-11-14"), 2: ("2023-11-14", "2023-11-14")}
    lines = spark.createDataFrame([(*r, None) for r in rows], line + ", title string")
    text = {r.conv_id: r.content for r in readers.chat_table(lines).collect()}
    assert text[2] == "# untitled\n\n## undated · user\nno clock\n\n## undated · user\nlost\n\n## 2023-11-14 · unknown\nearly\n\n## 2023-11-14 · user\nlate"


def test_dates_of_year_0_are_shown_as_none(spark, tmp_path):
    from lodestrata.plans import archive

    stated = ["0000", "0000-01", " 0000-01-01", "0000-00-00 00:00:00", "0001-12", None]
    spark.createDataFrame([(x,) for x in stated], "occurred_at string").write.parquet(f"{tmp_path}/sources.parquet")
    got = {r.value: r.date for r in archive.date_normalize(spark, str(tmp_path)).collect()}
    assert got == {x: None for x in stated[:4]} | {"0001-12": "0001-12"}
