import random

from pyspark.sql import functions as F

from lodestrata.operators.versions import version_history

SCHEMA = "origin string, at string, imported int, id string, title string, author string, removed string, bucket string, entity int"


def history(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = version_history(df, "origin", ["title", "author"], "at", ["imported", "id"], "removed", **options)
    return sorted((r.origin, r.version_no, r.valid_from, r.valid_to, r.n_versions) for r in got.collect())


def brute(rows):
    out = []
    for origin in {r[0] for r in rows if r[0] is not None}:
        last = {}
        for r in sorted((r for r in rows if r[0] == origin and r[1] is not None), key=lambda r: (r[1], r[2], r[3])):
            last[r[1]] = r
        starts, previous, end = [], None, None
        for at, r in sorted(last.items()):
            if r[4:6] != previous:
                starts.append(at)
            previous, end = r[4:6], r[6]
        for i, start in enumerate(starts):
            out.append((origin, i + 1, start, starts[i + 1] if i + 1 < len(starts) else end or "open", len(starts)))
    return sorted(out)


def row(origin, at, imported, title, author=None, removed=None, id="i"):
    return (origin, at, imported, id, title, author, removed, "x", 1)


def test_versions(spark):
    rows = [
        row("a", "2020-01-01", 1, "t1"), row("a", "2020-01-05", 2, "t1"), row("a", "2020-03-01", 3, "t2"), row("a", "2020-03-01", 4, "t3"),
        row("a", "2021-01-01", 5, "t1", removed="2022-01-01T00:00:00.000Z"), row("b", "2020-01-01", 1, None, "x"), row("b", "2020-01-02", 1, "x", None),
        row("c", None, 1, "lost"), row(None, "2020-01-01", 1, "lost"), row("d", "2020-01-01", 1, "one"), row("d", "2020-01-01", 1, "one"),
    ]
    assert history(spark, rows) == brute(rows)


def test_random_histories_at_every_bucket_size(spark):
    random.seed(3)
    rows = [
        row(random.choice("ab"), f"20{random.randint(10, 12)}-{random.randint(1, 12):02}-{random.randint(1, 28):02}", n, random.choice(["x", "y", None]), random.choice(["u", None]), random.choice([None, "2030"]), str(n))
        for n in range(300)
    ]
    expected = brute(rows)
    for chars in (4, 7, 10):
        assert history(spark, rows, bucket_chars=chars) == expected


def test_empty(spark):
    assert history(spark, []) == []


def test_merge_of_batches_with_late_snapshots(spark):
    from lodestrata.operators.versions import empty_dimension, merge_versions
    from lodestrata.session import cut_lineage

    random.seed(5)
    rules = ("origin", ["title", "author"], "at", ["imported", "id"], "removed")
    rows = [row(random.choice("abcd"), f"2020-{random.randint(1, 12):02}-{random.randint(1, 28):02}", n, random.choice(["x", "y", None]), random.choice(["u", None]), random.choice([None, "2030"]), str(n)) for n in range(60)]
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    shown = lambda d: sorted((r.origin, r.version_no, r.valid_from, r.valid_to, r.is_current) for r in d.collect())
    wanted = lambda part: [(*r[:4], r[1] == r[4]) for r in brute(part)]
    # Later ones that change, extend and close; late inside a version and at a stored time; of a new entity, of no entity or time.
    batches = [
        [row("a", "2021-01-01", 80, "z"), row("a", "2021-01-02", 81, "z", removed="2031"), row("b", "2021-03-01", 82, "x"), row("b", "2021-02-01", 83, "y")],
        [row("a", "2020-06-15", 90, "z"), row("a", "2022-01-01", 95, "q"), row("b", "2022-01-01", 91, "x"), row("e", "2020-01-01", 92, "x"), row(None, "2020-01-01", 93, "x"), row("c", None, 94, "x")],
        [],
        [row("b", "2022-01-01", 96, "other"), row("d", "2025-01-01", 97, None)],
    ]
    dimension = cut_lineage(merge_versions(empty_dimension(spark, "origin"), frame(rows), frame([]), *rules))
    assert shown(dimension) == wanted(rows)
    for batch in batches:
        dimension = cut_lineage(merge_versions(dimension, frame(batch), frame(rows), *rules))
        rows = rows + batch
        assert shown(dimension) == wanted(rows)
    # What the batch doesn't name is taken as it is stored, and so are closed versions.
    marked = dimension.withColumn("valid_to", F.when(~F.col("is_current") | (F.col("origin") == "c"), "stored").otherwise(F.col("valid_to")))
    kept = merge_versions(marked, frame([row("d", "2026-01-01", 99, "new")]), frame(rows), *rules).collect()
    assert {r.valid_to for r in kept if r.origin == "c"} == {"stored"} and [r.valid_to for r in kept if r.origin == "d"].count("stored") == len([r for r in brute(rows) if r[0] == "d"]) - 1
