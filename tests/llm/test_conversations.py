import json
import random

from lodestrata.llm import conversations as C

LINES = "line_id bigint, conv_id bigint, node_id string, role string, text string, created_at double, connection_id string"


def tree(*edges, messages=None):
    return json.dumps({k: {"id": k, "parent": p, "message": None if messages is not None and k not in messages else {"ref": k}} for k, p in edges})


def rebuild(spark, chats, lines):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    convs = spark.createDataFrame([(c, m, start + timedelta(days=d), "t") for c, m, d in chats], "conv_id bigint, mapping string, exported_at timestamp, title string")
    rows = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(lines)], LINES)
    return sorted(tuple(r) for r in C.rebuild(convs, rows).collect())


def test_follows_the_latest_branch(spark):
    mapping = tree(("r", None), ("a", "r"), ("b", "a"), ("c", "a"), ("d", "c"), messages={"a", "b", "c", "d"})
    lines = [(1, "a", "用户", "hi", 1.0), (1, "b", "bot", "old", 2.0), (1, "c", "ASSISTANT", "new", 3.0), (1, "d", None, " ​", 4.0), (1, "a", "用户", "hi", 1.0)]
    assert rebuild(spark, [(1, mapping, 0), (1, mapping, 1)], lines) == [(1, 0, "a", "user"), (1, 1, "c", "assistant")]


def test_broken_trees_are_dropped(spark):
    good = [("a", "user", "q", 1.0), ("b", "ai", "r", 2.0)]
    cases = {
        1: '{"a": {"id": "a"', 2: "[]", 3: "{}", 4: "null", 5: tree(("a", None), ("b", None)), 6: tree(("a", None), ("b", "zz")), 7: tree(("a", "b"), ("b", "a")),
        8: tree(("a", None), ("b", "a"), ("x", "y"), ("y", "x")), 9: tree(("a", None), ("b", "a"), ("lost", "b")), 10: tree(("a", None)), 11: '{"a": 3}', 12: tree(("a", None), ("b", "a")),
    }
    lines = [(c, *g) for c in cases for g in good]
    assert {r[0] for r in rebuild(spark, [(c, m, 0) for c, m in cases.items()], lines)} == {12}


def test_last_export_counts(spark):
    lines = [(1, "a", "user", "q", 1.0), (1, "b", "model", "r", 2.0), (2, "a", "user", "q", 1.0), (2, "b", "model", "r", 2.0)]
    mapping = tree(("a", None), ("b", "a"))
    assert {r[0] for r in rebuild(spark, [(1, mapping, 0), (1, "{", 1), (2, "{", 0), (2, None, 1)], lines)} == {2}


def test_nulls_and_empty(spark):
    assert rebuild(spark, [], []) == []
    assert rebuild(spark, [(None, None, 0), (1, None, 0)], [(None, "a", "user", "x", 1.0), (1, None, "user", "x", 1.0), (1, "a", "user", None, None)]) == []


def test_bare_conversations_against_brute_force(spark):
    random.seed(5)
    lines = []
    for conv in range(60):
        for n in range(random.randint(1, 8)):
            role = random.choice(["user", "assistant", "user", "assistant", "tool", None])
            lines.append((conv, f"{random.getrandbits(32):08x}", role, random.choice(["x", "x", "x", " "]), random.choice([1e9 + 4000 * n, 1e9 + 4000 * n, 0.0, None, 1.7e12 + n])))
    expected = []
    for conv in range(60):
        own = sorted((x for x in lines if x[0] == conv and x[3].strip()), key=lambda x: (x[4] is None, x[4] or 0, x[1]))
        roles = [x[2] or "unknown" for x in own]
        if own and C.accepts(roles):
            expected += [(conv, n, x[1], r) for n, (x, r) in enumerate(zip(own, roles))]
    assert expected and rebuild(spark, [(c, None, 0) for c in range(60)], lines) == sorted(expected)
