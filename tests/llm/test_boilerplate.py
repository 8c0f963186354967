import random
from datetime import datetime

import numpy as np

from lodestrata.llm import boilerplate as B

SCHEMA = "page_id bigint, url string, site string, title string, content string, fetched_at timestamp, lang string"
NOW = datetime(2024, 1, 1)


def removed(spark, pages, **options):
    rows = spark.createDataFrame([(i, u, s, t, c, NOW, None) for i, u, s, t, c in pages], SCHEMA)
    return sorted(tuple(r) for r in B.site_lines(rows, **options).collect())


def test_common_lines_is_a_longest_common_subsequence():
    random.seed(1)

    def longest(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(300):
        a, b = ([random.randint(0, 5) for _ in range(random.randint(0, 12))] for _ in range(2))
        found = B.common_lines(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert [i for i, _ in found] == sorted({i for i, _ in found}) and [j for _, j in found] == sorted({j for _, j in found})


def host(name, n, own="Own sentence number {0}.", foot="Written in {1} by hand"):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [(f"https://{name}/p/{i}", name, f"Title {letters[i]} · Fern", f"Daily Menu\r\n# Title {letters[i]}\n\n" + own.format(letters[i], name) + f"\n- {letters[i]} thing\nNext: Page {letters[-1 - i]}\n" + foot.format(letters[i], i * 7) + "\n") for i in range(n)]


def numbered(*hosts, start=0):
    return [(start + k, *page) for k, page in enumerate(p for h in hosts for p in h)]


def test_shared_lines_of_a_host_go_whatever_the_blocks(spark):
    pages = numbered(host("s.example", 20))
    got = removed(spark, pages)
    assert got == sorted((n, line) for n in range(20) for line in (1, 6, 7))
    # Many small blocks, and learned keys joined instead of sent.
    assert removed(spark, pages, block_pages=8) == got
    assert removed(spark, pages, block_pages=9, keys_sent=0) == got


def test_lone_pages_by_what_other_hosts_taught(spark):
    lone = "Daily Menu\n# A day\nI rewrote the menu of our shop.\n## Notes\nOddly, a thing\nNext: Another day\nMore of my own words, at length.\nWritten in 3 by hand"
    pages = numbered(host("s.example", 9), host("t.example", 9)) + [(99, "https://l.example/1", "l.example", "A day", lone)]
    assert [n for page, n in removed(spark, pages) if page == 99] == [1, 6, 8]
    # With nothing learned, only what stands before the heading or after the writing is known.
    assert [n for _, n in removed(spark, pages[-1:])] == [1, 8]


def test_titles_of_other_pages_and_blocks(spark):
    block = "Read on\n- Title a\n- Title b\n- Unheard of\nDaily End"
    pages = numbered([(u, s, t, c + block) for u, s, t, c in host("s.example", 9)])
    marked = spark.createDataFrame([(*p[:5], NOW, None) for p in pages], SCHEMA)
    reasons = {r.line_no: r.reason for r in B.marked_lines(marked).filter("page_id = 4").collect()}
    assert reasons == {1: "neighbours", 6: "frame of neighbours", 7: "neighbours", 8: "neighbours", 9: "neighbours", 10: "neighbours", 11: "neighbours", 12: "neighbours"}
    lone = numbered(host("s.example", 9)) + [(99, "u", "l.example", "Mine", "# Mine\nWords of mine, all of them.\nDaily Menu\n- Title a\n- Title b\n- Unheard of\nDaily Menu")]
    reasons = {r.line_no: r.reason for r in B.marked_lines(spark.createDataFrame([(*p[:5], NOW, None) for p in lone], SCHEMA)).filter("page_id = 99").collect()}
    assert reasons == {3: "wording", 4: "title", 5: "title", 6: "block", 7: "wording"}


def test_null_empty_and_repeated(spark):
    pages = [(1, None, None, None, None), (2, "https://a/", "a", None, ""), (3, "https://a/", "a", "", " \n\r\n"), (None, "u", "a", "t", "x"), (4, "https://b/x", "b", "T", "# T\nwords."), (4, "https://b/x", "b", "T", "# T\nwords.")]
    assert removed(spark, pages) == []
    assert removed(spark, []) == []


def test_a_line_repeated_very_often_is_aligned():
    same = B._sequence(np.zeros(5000, np.int64))
    assert len(B.common_lines([1, *same], [2, *same])) == 5000


def test_bodies(spark):
    pages = numbered(host("s.example", 6))
    rows = spark.createDataFrame([(*p, NOW, None) for p in pages], SCHEMA)
    assert {r.page_id: r.body for r in B.main_bodies(rows).collect()}[2] == "# Title c\n\nOwn sentence number c.\n- c thing"


def test_order_of_urls_is_by_number():
    urls = ["https://h/a/2", "https://h/a/10", "https://h/a/010/x", "https://h/b", None]
    assert sorted(urls[:4], key=B.url_order) == urls[:4] and B.url_order(None) == B.url_order("")
