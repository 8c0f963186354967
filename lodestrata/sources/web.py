"""Sites from tables of fetched pages: robots rules, sitemaps, feeds and a bounded crawl.

Nothing here opens a connection.  Pages come as a table (url, status, type,
body, final_url, links) that a fetcher outside has filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import urls
from lodestrata.session import cut_lineage
from lodestrata.sources import readers

#: Limits of one site's crawl.
MAX_PAGES, MAX_DEPTH, PAGE_BYTES, SITE_BYTES = 50, 2, 5 * 1024 * 1024, 100 * 1024 * 1024
MAX_SITEMAPS, MAX_FEEDS, MAX_HOPS = 16, 4, 5


def robots_rules(robots: DataFrame) -> DataFrame:
    """(site, rule, value): the Disallow paths under ``User-agent: *`` and all Sitemap lines of (site, body)."""
    lines = robots.select("site", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n?|\n")).alias("n", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"#.*$", "")))
    lines = lines.select("site", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("rule"), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1)).alias("value"))
    # A robots file is small, and its lines hold for those below them.
    agent = F.last(F.when(F.col("rule") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("site").orderBy("n"))
    lines = lines.withColumn("agent", agent)
    wanted = ((F.col("rule") == "disallow") & (F.col("agent") == "*")) | (F.col("rule") == "sitemap")
    return lines.filter(wanted & (F.col("value") != "")).select("site", "rule", "value").distinct()


def allowed(links: DataFrame, rules: DataFrame) -> DataFrame:
    """The links (site, url) whose path no Disallow rule of the site begins."""
    forbidden = rules.filter("rule = 'disallow'").select("site", F.col("value").alias("prefix"))
    path = F.concat(F.coalesce(F.nullif(urls.part(F.col("url"), 5), F.lit("")), F.lit("/")), urls.part(F.col("url"), 6))
    marked = links.withColumn("_path", path)
    hit = (marked["site"] == forbidden["site"]) & marked["_path"].startswith(forbidden["prefix"])
    return marked.join(forbidden, hit, "left_anti").drop("_path")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(site, kind, url, modified_at) of (site, body): pages of a sitemap, or further sitemaps of an index."""
    read = lambda tag: F.from_xml("body", f"{tag} array<struct<loc:string,lastmod:string>>", {"rowTag": "x", "mode": "PERMISSIVE"})[tag]
    both = sitemaps.select("site", F.explode(F.array(F.struct(F.lit("page").alias("kind"), read("url").alias("items")), F.struct(F.lit("sitemap").alias("kind"), read("sitemap").alias("items")))).alias("x"))
    rows = both.select("site", "x.kind", F.inline("x.items"))
    return rows.filter(F.col("loc").isNotNull()).select("site", "kind", urls.canonical_url(F.trim("loc")).alias("url"), F.trim("lastmod").alias("modified_at"))


def feed_urls(feeds: DataFrame) -> DataFrame:
    """(site, url, published_at) of (site, body), RSS or Atom."""
    rss = F.from_xml("body", "channel struct<item:array<struct<link:string,pubDate:string>>>")["channel"]["item"]
    atom = F.from_xml("body", "entry array<struct<link:struct<_href:string>,published:string,updated:string>>")["entry"]
    items = F.concat(
        F.coalesce(F.transform(rss, lambda i: F.struct(i["link"].alias("url"), i["pubDate"].alias("published_at"))), F.array().cast("array<struct<url:string,published_at:string>>")),
        F.coalesce(F.transform(atom, lambda e: F.struct(e["link"]["_href"].alias("url"), F.coalesce(e["published"], e["updated"]).alias("published_at"))), F.array().cast("array<struct<url:string,published_at:string>>")),
    )
    rows = feeds.select("site", F.inline(items))
    return rows.filter(F.col("url").isNotNull()).select("site", urls.canonical_url(F.trim("url")).alias("url"), F.trim("published_at").alias("published_at"))


def page_problem(status: Column, kind: Column, size: Column, url: Column, final_url: Column) -> Column:
    """Why a fetched page is skipped, NULL if it is not."""
    return (
        F.when(urls.origin_of(final_url) != urls.origin_of(url), "CROSS_ORIGIN_REDIRECT")
        .when(~status.between(200, 299), F.concat(F.lit("HTTP_"), status.cast("string")))
        .when(~F.coalesce(kind, F.lit("")).rlike(r"(?i)text/html|application/xhtml"), "NON_HTML")
        .when(size > PAGE_BYTES, "RESPONSE_TOO_LARGE")
        .when(size == 0, "EMPTY_CONTENT")
    )


def reachable(seeds: DataFrame, links: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(url, depth): what links (src, dst) reach from the seeds (url) within the depth, by the shortest way.

    Each round joins only the last round's pages and leaves out those already
    met; links outside a seed's directory are not followed.
    """
    start = seeds.select(urls.canonical_url(F.col("url")).alias("url")).distinct()
    scopes = start.select(urls.directory_of(F.col("url")).alias("scope")).distinct()
    clean = links.select(urls.canonical_url(F.col("src")).alias("src"), urls.canonical_url(F.col("dst")).alias("dst")).filter("src is not null and dst is not null").distinct()
    host = urls.origin_of
    # Each round reads the links inside; they are chosen once.
    inside = clean.join(scopes, (host(clean["dst"]) == host(scopes["scope"])) & clean["dst"].startswith(scopes["scope"]), "left_semi")
    inside = cut_lineage(inside)
    met = cut_lineage(start.withColumn("depth", F.lit(0)))
    frontier = met
    for depth in range(1, max_depth + 1):
        found = inside.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        frontier = cut_lineage(found.join(met.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        met = met.unionByName(frontier)
    return met


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, max_pages: int = MAX_PAGES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The pages a site's crawl takes, nearest first, at most ``max_pages`` per site, each with its skip_code."""
    met = reachable(seeds, links, max_depth).withColumn("site", urls.origin_of(F.col("url")))
    order = Window.partitionBy("site").orderBy("depth", "url")
    taken = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_pages)
    fetched = pages.select(urls.canonical_url(F.col("url")).alias("url"), "status", "type", "body", "final_url")
    joined = taken.join(fetched, "url").withColumn("size", F.octet_length("body"))
    code = page_problem(F.col("status"), F.col("type"), F.col("size"), F.col("url"), F.coalesce("final_url", "url"))
    joined = joined.withColumn("skip_code", code)
    total = F.sum(F.when(F.col("skip_code").isNull(), F.col("size")).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("skip_code", F.coalesce("skip_code", F.when(total > SITE_BYTES, "TOTAL_TOO_LARGE")))


def page_documents(pages: DataFrame, extracted: DataFrame) -> DataFrame:
    """Documents of pages (page_id, url) and their readable text (html.extract_pages)."""
    rows = pages.select("page_id", urls.canonical_url(F.col("url")).alias("origin")).distinct().join(extracted, "page_id")
    return rows.select(F.lit("web").alias("kind"), "origin", F.col("origin").alias("external_id"), "title", "content", "published_at", "modified_at", "author")


def wiki_documents(docs: DataFrame) -> DataFrame:
    """Documents of a wiki's rows: the first body that has text, times and author as given."""
    body = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("body_markdown", "body_html", "description")])
    return docs.select(
        F.lit("web").alias("kind"), F.concat(F.lit("wiki/"), F.coalesce("slug", F.col("id").cast("string"))).alias("origin"), "title", body.alias("content"),
        F.col("created_at").cast("string").alias("published_at"), F.col("updated_at").alias("modified_at"), F.col("user_name").alias("author"),
        F.col("id").cast("string").alias("external_id"), "connection_id", F.when(body.isNull(), "EMPTY_CONTENT").alias("skip_code"),
    )


def repository_documents(entries: DataFrame, repository: str, ref: str) -> DataFrame:
    """Documents of a repository's archive (readers.zip_entries), each read by its extension: its root folder cut off, references by others."""
    base = f"{repository}/tree/{ref}#"
    documents = readers.entry_documents(entries, F.concat(F.lit(base), readers.without_root(F.col("name"))))
    fixed = {"purpose": "reference", "authorship": "other", "content_scope": "sourced"}
    return documents.withColumns({**{c: F.lit(v) for c, v in fixed.items()}, "external_id": F.col("origin"), "original_path": F.substring("original_path", len(base) + 1, 1 << 20)})


def follow_redirects(pages: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(url, final_url, hops, skip_code) of fetched pages (url, status, location): where the redirects of each lead.

    TOO_MANY_REDIRECTS beyond ``max_hops`` and in a loop, CROSS_ORIGIN_REDIRECT
    to another origin, NOT_FETCHED where the table ends; each round joins only
    the pages that still move.
    """
    known = pages.select(urls.canonical_url(F.col("url")).alias("url"), "status", "location").filter("url is not null").dropDuplicates(["url"])
    moves = cut_lineage(known.filter(F.col("status").between(300, 399) & F.col("location").isNotNull()).select(F.col("url").alias("at"), F.when(F.col("location").startswith("/"), F.concat(urls.origin_of(F.col("url")), "location")).otherwise(F.col("location")).alias("to")))
    moves = moves.withColumn("to", urls.canonical_url(F.col("to")))
    moving = known.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("skip_code"))
    done = []
    for _ in range(max_hops + 1):
        met = moving.join(moves, F.col("final_url") == F.col("at"), "left")
        cross = urls.origin_of(F.col("to")) != urls.origin_of(F.col("url"))
        code = F.when(F.col("at").isNotNull() & F.coalesce(cross, F.lit(True)), "CROSS_ORIGIN_REDIRECT").when(F.col("at").isNotNull() & (F.col("hops") >= max_hops), "TOO_MANY_REDIRECTS")
        met = cut_lineage(met.withColumn("skip_code", code))
        done.append(met.filter("at is null OR skip_code is not null").select("url", "final_url", "hops", "skip_code"))
        moving = met.filter("at is not null AND skip_code is null").select("url", F.col("to").alias("final_url"), (F.col("hops") + 1).alias("hops"), "skip_code")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    fetched = known.select(F.col("url").alias("_known"))
    out = out.join(fetched, F.col("final_url") == F.col("_known"), "left")
    return out.select("url", "final_url", "hops", F.coalesce("skip_code", F.when(F.col("_known").isNull(), "NOT_FETCHED")).alias("skip_code"))


def followed(listings: DataFrame, most: int, kind: str) -> DataFrame:
    """Of the sitemaps or feeds (site, url) that a site names, the first ``most`` by URL of its own origin, others with a skip_code."""
    rows = listings.select("site", urls.canonical_url(F.col("url")).alias("url")).distinct()
    own = F.lower(urls.part(F.col("url"), 3)) == F.lower("site")
    place = F.row_number().over(Window.partitionBy("site", own).orderBy("url"))
    return rows.withColumn("skip_code", F.when(~F.coalesce(own, F.lit(False)), "CROSS_ORIGIN").when(place > most, f"TOO_MANY_{kind.upper()}"))


def sitemaps_followed(sitemaps: DataFrame) -> DataFrame:
    return followed(sitemaps, MAX_SITEMAPS, "sitemaps")


def feeds_followed(feeds: DataFrame) -> DataFrame:
    return followed(feeds, MAX_FEEDS, "feeds")
