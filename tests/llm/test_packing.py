from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import packing as P


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(0, 60), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once_within_capacity(capacity, counts):
    histogram = {k: n for k, n in counts.items() if k <= capacity}
    slots, opened = P.plan(histogram, capacity)
    used, placed = {}, {}
    for length, first, end, container, each in slots:
        for rank in range(first, end):
            assert rank == placed.get(length, 0)
            placed[length] = rank + 1
            at = container + (rank - first) // each
            assert at < opened
            used[at] = used.get(at, 0) + length
    assert placed == histogram and all(x <= capacity for x in used.values()) and len(used) == opened
    total = sum(k * n for k, n in histogram.items())
    # First-fit bound: no two containers are at most half full.
    assert sum(x * 2 <= capacity for x in used.values()) <= 1 or total == 0


def test_documents_take_their_slots(spark):
    counts = [(n, (n * 37) % 90) for n in range(400)] + [(1000, 250), (1001, 100), (1002, 0), (None, 5), (1003, None), (7, 7)]
    df = spark.createDataFrame(counts, "doc_id bigint, n_tokens bigint")
    sizes = spark.createDataFrame([(1, 100), (2, 64), (2, 64), (3, 0)], "size_id int, capacity_tokens int")
    rows = P.pack(df, sizes, salts=3).collect()
    for size, capacity in ((1, 100), (2, 64)):
        own = [r for r in rows if r.size_id == size]
        fill, whole = {}, {}
        for r in own:
            fill[r.container_no] = fill.get(r.container_no, 0) + r.n_tokens
            whole.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and set(fill) == set(range(max(fill) + 1))
        totals = {}
        for d, n in counts:
            if d is not None and n is not None:
                totals[d] = totals.get(d, 0) + n
        assert {d: sum(p[2] for p in pieces) for d, pieces in whole.items()} == totals
        assert all(n <= capacity and (n == capacity or piece == max(p[0] for p in whole[d] if p[1] // capacity == p[0])) for d, ps in whole.items() if d != 7 for piece, _, n in ps)
        assert sum(fill.values()) / (len(fill) * capacity) > 0.97
    assert P.pack(df.limit(0), sizes).isEmpty() and P.pack(df, sizes.limit(0)).isEmpty()


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "字 " * 5000, "x")], "doc_id bigint, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    assert 2 <= got[1] <= 4 and got[2] == got[3] == 0 and got[4] >= 5000
