import hashlib

from lodestrata.llm import formatdups as D

GROUPS = [
    ["# Straße\n\nA, b: 3.", "# STRASSE a B 3", "straße--a / b;3!!"],
    ['{"a": [1, 2], "b": {"c": "X y"}}', '{"b":{"c":"x-Y"},"a":[1,2]}'],
    ["---\nplace: low\nwith: Orla\n---\n# T\nbody", "---\nWITH : orla\n\nplace:  Low\n---\nt body."],
]
APART = ['{"a": [2, 1], "b": {"c": "X y"}}', '{"a": [1, 2], "c": {"b": "X y"}}', "---\nplace: Orla\nwith: low\n---\n# T\nbody", "body\n# T\n", '{"broken": ', "x²", "x2", "12 3 4", "ab", "---\nopen: end\nab"]


def collapse(spark, bodies, **options):
    rows = spark.createDataFrame([(hashlib.sha256(b.encode()).hexdigest(), b, "extra") for b in bodies], "hash string, content string, key string")
    return {r.hash: (r.rep_hash, r.n_rows) for r in D.collapse(rows, "hash", "content", **options).collect()}


def expected(groups):
    out = {}
    for g in groups:
        hashes = [hashlib.sha256(b.encode()).hexdigest() for b in g]
        out |= {h: (min(hashes), hashes.count(h)) for h in hashes}
    return out


def test_groups_with_and_without_salt(spark):
    groups = [g + g[:1] for g in GROUPS] + [[x] for x in APART]
    bodies = [b for g in groups for b in g]
    for hot in (100_000, 2, 3):
        assert collapse(spark, bodies, hot_rows=hot, salts=3) == expected(groups)


def test_copies(spark):
    rows = spark.createDataFrame([(hashlib.sha256(b.encode()).hexdigest(), b) for b in GROUPS[0] * 2], "hash string, content string")
    assert [tuple(r)[1:] for r in D.copies(D.collapse(rows, "hash", "content")).collect()] == [(3, 6)]


def test_null_empty_long(spark):
    rows = spark.createDataFrame([("a", None), (None, "x"), ("b", ""), ("c", "!?"), ("d", "x" * 200_000), ("e", "X " * 200_000), ("f", "[" * 100_000)], "hash string, content string")
    got = {r.hash: r.rep_hash for r in D.collapse(rows, "hash", "content").collect()}
    # Bodies without letters and digits are equal but for formatting.
    assert got == {"b": "b", "c": "b", "d": "d", "e": "d", "f": "b"}
    assert D.collapse(rows.limit(0), "hash", "content").isEmpty()


def test_a_hot_group_without_spark_choosing_broadcasts(spark):
    bodies = [f"one{' ' * (n % 40)}body{'.' * (n // 40)}" for n in range(400)] + [f"other {n}" for n in range(800)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(hashlib.sha256(b.encode()).hexdigest(), b) for b in bodies], "hash string, content string")
        df = D.collapse(rows, "hash", "content", hot_rows=300, salts=5)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # No row moves by the hot key alone: it is marked by a broadcast and spread by salts.
        assert plan.count("BroadcastHashJoin") >= 2
        got = {r.hash: r.rep_hash for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    hot = [hashlib.sha256(b.encode()).hexdigest() for b in bodies[:400]]
    assert len(got) == 1200 and {got[h] for h in hot} == {min(hot)}
