"""Conversations put together again from message rows.

A conversation has either a mapping (a JSON tree of entries that point to lines)
or, from older exports, only its lines.  Trees are checked and followed one by
one: a tree is never larger than the cell that held it.  Bare conversations may
be of any size, so their order and their automaton work in two levels, inside a
stretch of time and between the stretches.

The automaton reads the roles in order.  It has the states *quiet* and *asked*;
a user line leads from quiet to asked and from asked to failure, an assistant
line leads to quiet, the end fails in asked.  It accepts if it saw a user line.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spellings of the roles, in lower case.
ROLES = {
    "user": "user human 用户 用戶 人类 me client customer person utilisateur benutzer nutzer",
    "assistant": "assistant ai bot model 助手 助理 机器人 模型 gpt assistent chatbot",
    "system": "system 系统 系統 systeme système developer",
    "tool": "tool function 工具 函数 plugin outil werkzeug",
}

#: Text in which every character matches shows nothing on screen.
BLANK = r"^[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]*$"

ENTRY_SCHEMA = "conv_id bigint, export_no bigint, entry_no int, parent_no int, node_id string"
PATH_SCHEMA = "conv_id bigint, export_no bigint, turns array<struct<turn_no:int,node_id:string,role:string>>"


def speaker(role: Column) -> Column:
    """One of user, assistant, system, tool, unknown, whatever the spelling."""
    plain = F.lower(F.regexp_replace(role, r"[\s\p{Z}\p{Cf}:：]+", ""))
    pairs = [x for name, spellings in ROLES.items() for s in spellings.split() for x in (F.lit(s), F.lit(name))]
    return F.coalesce(F.create_map(*pairs)[plain], F.lit("unknown"))


def parse_tree(mapping: str | None) -> list[tuple[int, str | None]] | None:
    """(parent's number, node of the line) by entry number, parents first; None if the tree is unusable."""
    try:
        tree = json.loads(mapping)
    except (ValueError, RecursionError):
        return None
    if not isinstance(tree, dict) or not tree:
        return None
    children: dict[str, list[str]] = {}
    roots = []
    for key, entry in tree.items():
        if not isinstance(entry, dict):
            return None
        parent = entry.get("parent")
        if parent is None:
            roots.append(key)
        elif not isinstance(parent, str) or parent not in tree:
            return None
        else:
            children.setdefault(parent, []).append(key)
    if len(roots) != 1:
        return None
    order: list[tuple[int, str | None]] = []
    waiting = [(roots[0], -1)]
    for key, parent_no in waiting:  # grows while it is read
        message = tree[key].get("message")
        node = None
        if message is not None:
            node = message.get("ref", key) if isinstance(message, dict) else key
        order.append((parent_no, None if node is None else str(node)))
        waiting.extend((child, len(order) - 1) for child in children.get(key, ()))
    # Entries in a loop hang on no root.
    return order if len(order) == len(tree) else None


def _parse(batches):
    for batch in batches:
        conv, export, entry, parent, node = [], [], [], [], []
        for conv_id, export_no, mapping in zip(*(batch.column(i).to_pylist() for i in range(3))):
            # An unusable tree leaves one row, so that no older export takes its place.
            for n, (parent_no, node_id) in enumerate(parse_tree(mapping) or [(-2, None)]):
                conv.append(conv_id)
                export.append(export_no)
                entry.append(n)
                parent.append(parent_no)
                node.append(node_id)
        yield pa.RecordBatch.from_arrays(
            [pa.array(conv, pa.int64()), pa.array(export, pa.int64()), pa.array(entry, pa.int32()), pa.array(parent, pa.int32()), pa.array(node, pa.string())],
            ["conv_id", "export_no", "entry_no", "parent_no", "node_id"],
        )


def accepts(roles: list[str]) -> bool:
    asked = seen = False
    for role in roles:
        if role == "user":
            if asked:
                return False
            asked = seen = True
        elif role == "assistant":
            asked = False
    return seen and not asked


def follow(entries: list[tuple]) -> list[tuple[int, str, str]] | None:
    """The turns (turn_no, node_id, role) of one tree.

    ``entries`` holds (entry_no, parent_no, node_id, created_at, role, blank),
    with role NULL where the line is missing.  None for an unusable conversation.
    """
    children: dict[int, list[tuple]] = {}
    for entry in entries:
        children.setdefault(entry[1], []).append(entry)
    if -2 in children:
        return None
    at, turns = -1, []
    while at in children:
        lowest = float("-inf")
        # A line without time, or no line, comes before all others; equal times are decided by node.
        entry = max(children[at], key=lambda e: (lowest if e[3] is None or e[3] != e[3] else e[3], e[2] or ""))
        at = entry[0]
        if entry[2] is None:
            continue
        if entry[4] is None:
            return None
        if not entry[5]:
            turns.append((entry[2], entry[4]))
    if not turns or not accepts([role for _, role in turns]):
        return None
    return [(n, node, role) for n, (node, role) in enumerate(turns)]


def _walk(batches):
    kind = pa.list_(pa.struct([("turn_no", pa.int32()), ("node_id", pa.string()), ("role", pa.string())]))
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        fields = list(zip(*(flat.field(i).to_pylist() for i in range(6))))
        ends = lists.offsets.to_pylist()
        base = ends[0]
        paths = [follow(fields[a - base : b - base]) for a, b in zip(ends, ends[1:])]
        out = [None if p is None else [dict(zip(("turn_no", "node_id", "role"), t)) for t in p] for p in paths]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["conv_id", "export_no", "turns"])


def _single_lines(lines: DataFrame) -> DataFrame:
    """One row per (conv_id, node_id): the line stored first."""
    slim = lines.filter(F.col("conv_id").isNotNull() & F.col("node_id").isNotNull()).select(
        "conv_id",
        "node_id",
        F.struct("line_id", "created_at", speaker(F.col("role")).alias("role"), F.coalesce(F.col("text").rlike(BLANK), F.lit(True)).alias("blank")).alias("line"),
    )
    return slim.groupBy("conv_id", "node_id").agg(F.min("line").alias("line")).select("conv_id", "node_id", "line.created_at", "line.role", "line.blank")


def _tree_turns(conversations: DataFrame, lines: DataFrame) -> DataFrame:
    mapped = conversations.filter(F.col("mapping").isNotNull()).select("conv_id", "export_no", "mapping")
    entries = mapped.mapInArrow(_parse, ENTRY_SCHEMA)
    met = entries.join(lines, ["conv_id", "node_id"], "left")
    trees = met.groupBy("conv_id", "export_no").agg(
        F.collect_list(F.struct("entry_no", "parent_no", "node_id", "created_at", "role", "blank")).alias("entries")
    )
    # Rows of one export that are there twice give every entry twice, which changes no path.
    paths = trees.mapInArrow(_walk, PATH_SCHEMA)
    last = paths.groupBy("conv_id").agg(F.max_by("turns", "export_no").alias("turns"))
    return last.select("conv_id", F.inline("turns"))


def _bare_turns(bare: DataFrame, lines: DataFrame) -> DataFrame:
    # Lines without a usable clock share one time; the node's first characters split them.
    clocked = F.coalesce((F.col("created_at") > 0) & (F.col("created_at") < 1e15), F.lit(False))
    stretch = F.struct(
        F.col("created_at").isNull().alias("late"),
        F.when(clocked, F.floor(F.col("created_at") / 3600)).otherwise(F.coalesce(F.col("created_at"), F.lit(0))).cast("double").alias("hour"),
        F.when(clocked, F.lit("")).otherwise(F.substring("node_id", 1, 2)).alias("start"),
    )
    shown = lines.filter(~F.col("blank")).join(bare, "conv_id").withColumn("stretch", stretch)
    key = F.struct(F.col("created_at").isNull().alias("late"), "created_at", "node_id")
    within = Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_last("created_at"), "node_id")
    numbered = shown.withColumn("place", F.row_number().over(within))

    # What the automaton does in a stretch depends only on these figures.
    spoken = F.when(F.col("role").isin("user", "assistant"), F.col("role"))
    heard = F.last(spoken, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    read = numbered.withColumns({"spoken": spoken, "failed": F.coalesce((F.col("role") == "user") & (heard == "user"), F.lit(False))})
    stretches = read.groupBy("conv_id", "stretch").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("spoken", F.when(F.col("spoken").isNotNull(), key)).alias("first_role"),
        F.max_by("spoken", F.when(F.col("spoken").isNotNull(), key)).alias("last_role"),
        F.max("failed").alias("failed"),
        F.max(F.col("role") == "user").alias("asks"),
    )
    across, whole = Window.partitionBy("conv_id").orderBy("stretch"), Window.partitionBy("conv_id")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.withColumns(
        {
            "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "failed": F.col("failed") | F.coalesce((F.col("first_role") == "user") & (F.last("last_role", ignorenulls=True).over(earlier) == "user"), F.lit(False)),
            "still": F.last("last_role", ignorenulls=True).over(across),
        }
    )
    stretches = stretches.select(
        "conv_id",
        "stretch",
        "before",
        (~F.max("failed").over(whole) & F.max("asks").over(whole) & (F.max_by("still", "stretch").over(whole) != "user")).alias("kept"),
    )
    turns = numbered.join(stretches.filter("kept"), ["conv_id", "stretch"])
    return turns.select("conv_id", (F.col("before") + F.col("place") - 1).cast("int").alias("turn_no"), "node_id", "role")


def rebuild(conversations: DataFrame, lines: DataFrame) -> DataFrame:
    """(conv_id, turn_no, node_id, role) for every line of every usable conversation.

    ``conversations`` has conv_id, mapping, exported_at; ``lines`` has line_id,
    conv_id, node_id, role, text, created_at.  Of several exports of one
    conversation the last counts.  Lines that are there twice count once, lines
    without text (null, empty, invisible) are left out.  With equal times the
    greatest node is followed.  Rows without conv_id are left out; empty tables
    give no rows.
    """
    lines = _single_lines(lines)
    exports = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "mapping", F.coalesce(F.unix_micros("exported_at"), F.lit(-(2**62))).alias("export_no")
    )
    last = exports.groupBy("conv_id").agg(F.max_by(F.col("mapping").isNull(), F.struct("export_no", F.col("mapping").isNotNull())).alias("bare"))
    bare = last.filter("bare").select("conv_id")
    trees = _tree_turns(exports, lines).join(bare, "conv_id", "left_anti")
    return trees.select("conv_id", "turn_no", "node_id", "role").unionByName(_bare_turns(bare, lines))
