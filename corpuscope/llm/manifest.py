"""Merkle manifest of a table by octopus multiproofs.

Rows are leaves, ordered by key within their group; sixteen consecutive nodes make one node of the
next level until one is left, the group's subroot; subroots in the order of the groups make the
root in the same way. Every leaf gets its proof: level by level its place in its run and the
digests of the others in it.

Leaves are sorted once by range, so a group that holds a third of all rows lies in many tasks, and
cut into *parts* of a fixed number of consecutive leaves. Where a part begins in its group follows
from counts per group and task of the sort. Then

1. every part derives the nodes that lie wholly in it and hands out those of runs that it shares
   with other parts, and the coordinates that it lacks: at each level the rest of the first and of
   the last run above its leaves, which is the least union of siblings for all its proofs;
2. the shared runs, a few nodes for each part, are finished level by level up to the root;
3. every part fetches its coordinates by one join, derives the interiors that its leaves share
   once and writes out a proof for each leaf.

Nothing larger than a part is in one place; what is sent to the driver is one number for each task
of the sort and one root.

Edge cases: a null group comes first, then groups by their UTF-8 bytes; null keys come first; rows
that share group and key are ordered by their leaf, so repeated rows can take each other's place
and nothing else can; an empty table has no rows and no root. Null, empty and very long texts are
values like others: ``-`` for null, ``0:`` for the empty text. Other columns have no part in it.
"""
from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuscope.llm.common import hold, release

ARITY = 16
SHIFT = 4
#: Leaves of a part: two to this power.
PART_BITS = 13
#: Leaves of a task of the sort, and the least that are worth one.
TASK_LEAVES, LEAST_LEAVES = 1 << 20, 1 << 12
#: The tree of subroots. Nodes of it and of the upper levels are asked for by many parts, so their requests are salted.
TOP, UPPER_LEVEL, SALTS = -1, 4, 32
PROOF = "array<struct<position int, siblings string>>"
NODES = "kind int, part long, tree long, n long, level int, idx long, hash string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and itself, or - if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a proof gives for a leaf."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(
        F.substring(p["siblings"], F.lit(1), 64 * p["position"]), h, F.substring(p["siblings"], 64 * p["position"] + 1, F.lit(64 * ARITY))).cast("binary"), 256))


def digests(proof: Column) -> Column:
    """All siblings of a proof, level by level and left to right, as one text."""
    return F.array_join(proof["siblings"], "")


def parent(hashes: list[str]) -> str:
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level above n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def levels_of(n: int) -> int:
    """Levels below the last node of a tree with n leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def own_nodes(lo: int, hashes: list[str], n: int) -> tuple[list[tuple[int, int, str]], str | None]:
    """(level, idx, hash) of the nodes whose run is not wholly derived here, and the last node if it is."""
    out = []
    for level in range(levels_of(n)):
        hi, end = lo + len(hashes), width(n, level)
        up_lo = -(-lo // ARITY)
        up_hi = -(-hi // ARITY) if hi == end else hi // ARITY
        up_hi = max(up_lo, up_hi)
        cut = min(up_lo * ARITY, hi) - lo
        rest = max(cut, up_hi * ARITY - lo)
        out += [(level, lo + i, h) for i, h in enumerate(hashes) if i < cut or i >= rest]
        hashes = [parent(hashes[i:i + ARITY]) for i in range(cut, min(rest, len(hashes)), ARITY)]
        lo = up_lo
    return out, hashes[0] if hashes else None


def missing(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the least set of nodes that gives, with leaves lo .. hi - 1, all their proofs."""
    out = []
    last = hi - 1
    for level in range(levels_of(n)):
        end = width(n, level)
        out += [(level, i) for i in range(lo // ARITY * ARITY, lo)]
        out += [(level, i) for i in range(last + 1, min(end, (last // ARITY + 1) * ARITY))]
        lo, last = lo // ARITY, last // ARITY
    return out


def shared_levels(lo: int, hashes: list[str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[tuple[int, list[tuple[int, str]]]], str]:
    """Per level the first node above the leaves and (position, siblings) of each such node; the last node.

    Every node above the leaves is derived once, from derived and fetched ones.
    """
    out = []
    for level in range(levels_of(n)):
        end, first, last = width(n, level), lo // ARITY * ARITY, lo + len(hashes) - 1
        stop = min(end, (last // ARITY + 1) * ARITY)
        row = [fetched[level, i] for i in range(first, lo)] + hashes + [fetched[level, i] for i in range(last + 1, stop)]
        runs = ["".join(row[i:i + ARITY]) for i in range(0, len(row), ARITY)]
        entries = []
        for i in range(lo - first, last + 1 - first):
            run, at = runs[i // ARITY], i % ARITY
            entries.append((at, run[:64 * at] + run[64 * (at + 1):]))
        out.append((lo, entries))
        hashes, lo = [hashlib.sha256(r.encode()).hexdigest() for r in runs], first // ARITY
    return out, hashes[0]


def ordered(leaves: DataFrame) -> DataFrame:
    """The leaves sorted by range, with ``mid``: their place among the rows of their task, and the task's number above bit 33."""
    spark = leaves.sparkSession
    held = hold(leaves)
    n = held.count()
    tasks = max(-(-n // TASK_LEAVES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_LEAVES)), 1)
    order = [F.asc_nulls_first("tree_group"), F.asc_nulls_first("tree_key"), F.asc("leaf")]
    out = hold(held.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id()))
    release(held)
    return out


def placed_parts(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(part, tree, lo, count, n) of the leaves of each group in each part, and the number of groups."""
    spark = leaves.sparkSession
    in_task = leaves.groupBy(F.shiftright("mid", 33).alias("task"), "tree_group").agg(F.min("mid").alias("first"), F.count("*").alias("count"))
    of_group = Window.partitionBy("tree_group")
    before = F.sum("count").over(of_group.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    seen = hold(in_task.select("*", F.coalesce(before, F.lit(0)).alias("lo"), F.sum("count").over(of_group).alias("n")))
    begun = {r["task"]: r["k"] for r in seen.filter("lo = 0").groupBy("task").agg(F.count("*").alias("k")).collect()}  # a number for each task of the sort
    base, total = [], 0
    for task in sorted(begun):
        base.append((task, total))
        total += begun[task]
    if not total:
        return seen.limit(0).select(*[F.lit(0).cast("long").alias(c) for c in ("part", "tree", "lo", "count", "n")]), 0
    numbered = seen.join(spark.createDataFrame(base, "task long, base long"), "task", "left")
    # groups that begin in a task are numbered there; a group goes by the number of its first task
    begins = (F.col("lo") == 0).cast("int")
    rank = F.sum(begins).over(Window.partitionBy("task").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    numbered = numbered.withColumn("own", F.when(F.col("lo") == 0, F.col("base") + F.coalesce(rank, F.lit(0))))
    numbered = numbered.withColumn("tree", F.max("own").over(of_group))
    part = F.explode(F.sequence(F.shiftright("first", PART_BITS), F.shiftright(F.col("first") + F.col("count") - 1, PART_BITS)))
    cut = numbered.select("tree", "first", "count", "lo", "n", part.alias("part"))
    start = F.greatest("first", F.call_function("shiftleft", F.col("part"), F.lit(PART_BITS)))
    end = F.least(F.col("first") + F.col("count"), F.call_function("shiftleft", F.col("part") + 1, F.lit(PART_BITS)))
    out = hold(cut.select("part", "tree", (F.col("lo") + start - F.col("first")).alias("lo"), (end - start).alias("count"), "n"))
    release(seen)
    return out, total


def _segments(plan: pa.Table) -> list[tuple[int, int, int, int]]:
    return sorted(zip(*(plan.column(c).to_pylist() for c in ("tree", "lo", "count", "n"))))


def _in_order(leaves: pa.Table) -> pa.Table:
    return leaves.take(pa.array(np.argsort(leaves.column("mid").to_numpy(), kind="stable")))


def own_and_missing(leaves: DataFrame, plan: DataFrame, groups: int) -> DataFrame:
    """Nodes of shared runs (kind 0) and coordinates to fetch (kind 1) of every part."""
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string())])

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("part")[0].as_py()
        hashes = _in_order(left).column("leaf").to_pylist()
        rows, subroots, at = [], [], 0
        segments = _segments(right)
        for tree, lo, count, n in segments:
            nodes, last = own_nodes(lo, hashes[at:at + count], n)
            at += count
            rows += [(0, number, tree, n, level, i, h) for level, i, h in nodes]
            if count == n:
                subroots.append((tree, last))
            else:
                rows += [(1, number, tree, n, level, i, None) for level, i in missing(lo, lo + count, n)]
        if subroots:
            nodes, last = own_nodes(subroots[0][0], [h for _, h in subroots], groups)
            rows += [(0, number, TOP, groups, level, i, h) for level, i, h in nodes]
            if len(subroots) == groups:
                rows.append((0, number, TOP, groups, levels_of(groups), 0, last))
        rows += [(1, number, TOP, groups, level, i, None) for level, i in missing(segments[0][0], segments[-1][0] + 1, groups)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, schema)], schema=schema)

    return leaves.select("part", "mid", "leaf").groupBy("part").cogroup(plan.groupBy("part")).applyInArrow(part, NODES)


def _next_level(nodes: DataFrame, level: int) -> DataFrame:
    """Parents of the runs of one level, for trees that go on there."""
    run = F.array_sort(F.collect_list(F.struct("idx", "hash")))  # at most ARITY nodes
    return (nodes.filter((F.col("level") == level) & (F.col("n") > F.lit(ARITY)**level)).groupBy("tree", "n", F.shiftright("idx", SHIFT).alias("idx"))
            .agg(F.sha2(F.array_join(run["hash"], "").cast("binary"), 256).alias("hash"))
            .select("tree", "n", F.lit(level + 1).alias("level"), "idx", "hash"))


def climbed(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """The nodes made from runs of given and made nodes, a table for each level."""
    made, here = [], nodes.filter("level = 0")
    for level in range(depth):
        made.append(hold(_next_level(here, level)))
        here = made[-1].unionByName(nodes.filter(F.col("level") == level + 1))
    return made


def finished(nodes: DataFrame, groups: int, deepest: int) -> tuple[list[DataFrame], str]:
    """Tables of all nodes of shared runs (tree, n, level, idx, hash), and the root.

    ``deepest`` is the number of leaves of the largest group that lies in several parts.
    """
    given = nodes.select("tree", "n", "level", "idx", "hash")
    tables = climbed(given.filter(F.col("tree") != TOP), levels_of(deepest))
    top = given.filter(F.col("tree") == TOP)
    if tables:  # the last node of each such group is a leaf of the tree of subroots
        last = (F.lit(ARITY)**(F.col("level") - 1) < F.col("n")) & (F.col("n") <= F.lit(ARITY)**F.col("level"))
        ends = _union(tables).filter(last).select(F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.lit(0).alias("level"),
                                                  F.col("tree").alias("idx"), "hash")
        tables.append(hold(ends))
        top = top.unionByName(tables[-1])
    made = climbed(top, levels_of(groups))
    root = _union([top, *made]).filter(F.col("level") == levels_of(groups)).head()["hash"]
    return [given, *tables, *made], root


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def fetched(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(part, tree, level, idx, hash) of the coordinates asked for.

    Nodes of the tree of subroots and of upper levels are few and wanted by many parts: each is
    there once for every salt.
    """
    wide = (F.col("tree") == TOP) | (F.col("level") >= UPPER_LEVEL)
    salts = F.when(wide, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = wanted.select("part", "tree", "level", "idx", F.when(wide, F.pmod(F.col("part"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    right = nodes.select("tree", "level", "idx", "hash", F.explode(salts).alias("salt"))
    return left.join(right, ["tree", "level", "idx", "salt"]).select("part", "tree", "level", "idx", "hash")


def expanded(leaves: DataFrame, given: DataFrame, groups: int) -> DataFrame:
    """The leaves with subroot, tree_root and proof, part by part.

    ``given`` has the parts' segments (lo, count, n) and fetched nodes (level, idx, hash).
    """
    carried = [f for f in leaves.schema.fields if f.name not in ("part", "mid")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + f", subroot string, tree_root string, proof {PROOF}"

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _in_order(left)
        hashes = left.column("leaf").to_pylist()
        is_node = right.column("hash").is_valid()
        got: dict[int, dict[tuple[int, int], str]] = {}
        for tree, level, i, h in zip(*(right.filter(is_node).column(c).to_pylist() for c in ("tree", "level", "idx", "hash"))):
            got.setdefault(tree, {})[level, i] = h
        segments = _segments(right.filter(right.column("hash").is_null()))
        places: list[np.ndarray] = []   # for each leaf its entries, by number
        entries: list[tuple[int, str]] = []
        subroots, at = [], 0

        def numbered(levels: list, idx: np.ndarray) -> np.ndarray:
            out = np.empty((len(idx), len(levels)), np.int64)
            for k, (first, found) in enumerate(levels):
                out[:, k] = len(entries) + (idx >> (SHIFT * k)) - first
                entries.extend(found)
            return out

        for tree, lo, count, n in segments:
            levels, last = shared_levels(lo, hashes[at:at + count], n, got.get(tree, {}))
            places.append(numbered(levels, np.arange(lo, lo + count)))
            subroots.append(last)
            at += count
        trees = np.array([s[0] for s in segments])
        levels, root = shared_levels(int(trees[0]), subroots, groups, got.get(TOP, {}))
        above = numbered(levels, trees)
        counts = [s[2] for s in segments]
        rows = [np.concatenate([own, np.broadcast_to(up, (len(own), len(up)))], axis=1) for own, up in zip(places, above)]
        lengths = np.concatenate([np.full(len(r), r.shape[1], np.int32) for r in rows])
        kind = pa.struct([("position", pa.int32()), ("siblings", pa.string())])
        table = pa.StructArray.from_arrays([pa.array([e[0] for e in entries], pa.int32()), pa.array([e[1] for e in entries], pa.string())], names=["position", "siblings"])
        taken = table.take(pa.array(np.concatenate([r.ravel() for r in rows])))
        proof = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), taken.cast(kind))
        columns = [left.column(f.name) for f in carried]
        names = [f.name for f in carried]
        repeated = pa.array(subroots, pa.string()).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
        return pa.table([*columns, repeated, pa.array([root] * left.num_rows, pa.string()), proof], names=[*names, "subroot", "tree_root", "proof"])

    return leaves.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(part, ddl)


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, **carried: Column) -> tuple[DataFrame, str | None]:
    """(one row per leaf: group, key, leaf, the carried columns, subroot, root, proof; the root).

    ``proof`` has for every level from the leaf to the root the position of its node in its run
    and the digests of the other nodes of the run, left to right, as one text.
    """
    start = rows.select(F.col(f"`{group}`").alias("tree_group"), F.col(f"`{key}`").alias("tree_key"), leaf.alias("leaf"), *[c.alias(f"carried_{n}") for n, c in carried.items()])
    sorted_leaves = ordered(start)
    plan, groups = placed_parts(sorted_leaves)
    leaves = sorted_leaves.withColumn("part", F.shiftright("mid", PART_BITS))
    root, out = None, None
    if groups:
        found = hold(own_and_missing(leaves, plan, groups))
        deepest = plan.filter("count < n").agg(F.max("n")).first()[0] or 0
        tables, root = finished(found.filter("kind = 0"), groups, deepest)
        nodes = fetched(found.filter("kind = 1"), _union(tables))
        none = F.lit(None).cast("long")
        given = hold(plan.select("part", "tree", "lo", "count", "n", none.cast("int").alias("level"), none.alias("idx"), none.cast("string").alias("hash")).unionByName(
            nodes.select("part", "tree", none.alias("lo"), none.alias("count"), none.alias("n"), "level", "idx", "hash")))
        release(found, *tables, plan)
        out = expanded(leaves, given, groups)
    else:
        out = start.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("subroot", "string"), ("tree_root", "string"), ("proof", PROOF))])
    return out.select(F.col("tree_group").alias(group), F.col("tree_key").alias(key), "leaf", *[F.col(f"carried_{n}").alias(n) for n in carried],
                      "subroot", F.col("tree_root").alias("root"), "proof"), root


def document_proofs(docs: DataFrame) -> DataFrame:
    """The manifest of documents by source, with the leaf that tampering would give (null where nothing is tampered with).

    Tampering lower-cases the letters A-Z of the text where 5 divides the CRC-32 of the id; a null
    id is left alone.
    """
    columns = ["doc_id", "source", "lang", "n_chars"]
    own = [F.col(c) for c in columns]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(docs, "source", "doc_id", leaf_digest(*own, F.col("text")),
                    tampered=F.when(hit, leaf_digest(*own, F.translate("text", UPPER, LOWER))))[0]


def digest_table(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document."""
    out = document_proofs(docs).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(digests(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
