"""Merkle manifests of a dataset: a digest tree over the rows of each group, one over the groups, and a proof for every row.

Rows get their places in the tree from one sort by ranges and the counts of its partitions, so no group is ever in one task. Aligned blocks of places are subtrees of their own: a block is a
contiguous matrix of hexadecimal digests, reshaped by the fanout and hashed level by level. The blocks' roots are the leaves of the next round, of which a few make a tree of any size; on the way
back each block gets the siblings above it and adds its own, whose places are index arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Leaves of a block, at most: the largest power of the fanout that is no more.
BLOCK = 4096


def field(c: Column) -> Column:
    """A value as part of a leaf: its length in bytes, a colon and the value; a null is a dash."""
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _digest(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*map(field, values)), "UTF-8"), 256)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Digests as the rows of a matrix of hexadecimal digits."""
    return np.frombuffer("".join(column.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def _parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    whole = len(nodes) // fanout * fanout
    rows = [*nodes[:whole].reshape(-1, fanout * 64), *([nodes[whole:].ravel()] if whole < len(nodes) else [])]
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in rows).encode(), np.uint8).reshape(-1, 64)


def _levels(nodes: np.ndarray, fanout: int, n: int, block: int) -> list[np.ndarray]:
    """The levels of a block's subtree, from its nodes to its root.  ``n``: nodes of the whole tree at this level; if there are more blocks, each goes up the same number of levels."""
    levels, width = [nodes], min(n, block)
    while width > 1:
        levels.append(_parents(levels[-1], fanout))
        width = -(-width // fanout)
    return levels


def _around(levels: list[np.ndarray], fanout: int) -> list[tuple[list[str], list[str]]]:
    """For each level but the root: what stands to the left and to the right of each node in its run."""
    out = []
    for nodes in levels[:-1]:
        text, m = nodes.tobytes().decode(), len(nodes)
        first = [a // fanout * fanout for a in range(m)]
        out.append(([text[64 * s : 64 * a] for a, s in enumerate(first)], [text[64 * (a + 1) : 64 * min(s + fanout, m)] for a, s in enumerate(first)]))
    return out


def _siblings(around: list[tuple[list[str], list[str]]], i: int, fanout: int) -> list[tuple[str, str]]:
    """Of leaf ``i``: (left, right) siblings, level by level."""
    out = []
    for left, right in around:
        out.append((left[i], right[i]))
        i //= fanout
    return out


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place of each in its group (column key) in the given order, and n, the size of the group.

    A sort by ranges numbers the rows of each partition; how many rows of a group stand in partitions before is a sum over partitions. ``order`` begins with key and tells all rows apart.
    """
    parts = common.width(rows.sparkSession)
    dealt = rows.repartitionByRange(parts, *[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    dealt = common.stage(dealt.withColumn("nth", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("nth", 33))
    per = dealt.groupBy("key", "part").agg(F.count("*").alias("many"), F.min("nth").alias("first"))
    whole = Window.partitionBy("key")
    before = F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("many")
    per = common.stage(per.select("key", "part", "first", before.alias("before"), F.sum("many").over(whole).alias("n")), "parts")  # a row for each partition and group in it
    return dealt.join(per, ["key", "part"]).withColumn("pos", F.col("nth") - F.col("first") + F.col("before")).drop("part", "first", "before", "nth")


def _up(nodes: DataFrame, fanout: int, block: int) -> DataFrame:
    """(key, pos, n, digest) of the blocks' roots."""

    def run(table):
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        root = _levels(_matrix(table["digest"]), fanout, n, block)[-1].tobytes().decode()
        return pa.table({"key": [table["key"][0].as_py()], "pos": [table["pos"][0].as_py() // block], "n": [-(-n // block)], "digest": [root]}, schema=pa.schema([("key", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    return nodes.select("key", "pos", "n", "digest").groupBy("key", F.expr(f"pos div {block}")).applyInArrow(run, "key string, pos long, n long, digest string")


def _rounds(nodes: DataFrame, fanout: int, block: int) -> list[DataFrame]:
    """The nodes themselves, their blocks' roots, and so on, until every group has one node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 1) > 1:
        rounds.append(common.stage(_up(rounds[-1], fanout, block), "roots"))
    return rounds


_PATH = "left array<string>, right array<string>"


def _down(nodes: DataFrame, paths: DataFrame, fanout: int, block: int) -> DataFrame:
    """(key, pos, left, right, top) of nodes, from those of their blocks: the siblings of each up to the root, level by level."""

    def run(own, above):
        if not own.num_rows:
            return schema.empty_table()
        own = own.sort_by("pos")
        around = _around(_levels(_matrix(own["digest"]), fanout, own["n"][0].as_py(), block), fanout)
        left, right = above["left"][0].as_py(), above["right"][0].as_py()
        each = [_siblings(around, i, fanout) for i in range(own.num_rows)]
        return pa.table({"key": own["key"], "pos": own["pos"], "left": [[a for a, _ in s] + left for s in each], "right": [[b for _, b in s] + right for s in each], "top": [above["top"][0].as_py()] * own.num_rows}, schema=schema)

    strings = pa.list_(pa.string())
    schema = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("left", strings), ("right", strings), ("top", pa.string())])
    blocks = nodes.select("key", "pos", "n", "digest").groupBy("key", F.expr(f"pos div {block}"))
    return blocks.cogroup(paths.groupBy("key", "pos")).applyInArrow(run, f"key string, pos long, {_PATH}, top string")


def manifest(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    fanout: int = 2,
    block: int = BLOCK,
    seen: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: id, leaf, subroot (of its group), root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the fields of ``columns``. Leaves of a group ascend by id, a null id first, rows of equal id by leaf; every ``fanout`` consecutive nodes, the last ones of a level
    perhaps fewer, become the digest of their digests, until one is left: the subroot. Subroots, a null group first, then bytewise, make the root in the same way. The proof is what the
    run of a node holds besides it, from the leaf to the root; proof_sha256 is the digest of all these siblings. ``seen`` has values of columns as they are found later (by default as they are):
    the row's leaf is made of them anew and folded with the siblings to folded_root, and verified says whether this is the root.

    Repeated rows are leaves of their own each. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    size = fanout
    while size * fanout <= block:
        size *= fanout
    found = [(seen or {}).get(c, F.col(c)) for c in columns]
    group = F.col(group_col).cast("string")
    leaves = docs.select(F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group)).alias("key"), F.col(id_col).cast("long").alias("id"), _digest([F.col(c) for c in columns]).alias("digest"), _digest(found).alias("found"))
    # Digests that are as before are not kept twice; the tie tells repeated rows apart.
    leaves = common.stage(leaves.withColumns({"found": F.when(F.col("found") != F.col("digest"), F.col("found")), "tie": F.monotonically_increasing_id()}), "leaves")
    nodes = common.stage(placed(leaves, ["key", "id", "digest", "tie"]).drop("tie"), "nodes")
    groups = _rounds(nodes, fanout, size)
    subroots = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "digest")
    subroots = common.stage(placed(subroots, ["key", "of"]), "subroots")  # a row for each group
    tops = _rounds(subroots, fanout, size)
    last = tops[-1].select("digest").first()
    root = last[0] if last else None

    none = F.array().cast("array<string>")
    path = tops[-1].select("key", "pos", none.alias("left"), none.alias("right"), F.col("digest").alias("top"))
    for level in reversed(tops[:-1]):
        path = common.stage(_down(level, path, fanout, size), "paths")
    path = subroots.join(path, ["key", "pos"]).select(F.col("of").alias("key"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("digest").alias("top"))
    for level in reversed(groups[1:-1]):
        path = common.stage(_down(level, path, fanout, size), "paths")
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = pa.schema([("id", pa.int64()), *[(n, pa.string()) for n in names[1:-1]], ("verified", pa.bool_())])

    def prove(own, above):
        if not own.num_rows:
            return schema.empty_table()
        own = own.sort_by("pos")
        around = _around(_levels(_matrix(own["digest"]), fanout, own["n"][0].as_py(), size), fanout)
        higher = list(zip(above["left"][0].as_py(), above["right"][0].as_py(), strict=True))
        end = "".join(a + b for a, b in higher).encode()
        digests, proofs, folded = own["digest"].to_pylist(), [], []
        for i, (leaf, changed) in enumerate(zip(digests, own["found"].to_pylist(), strict=True)):
            siblings = _siblings(around, i, fanout)
            proofs.append(hashlib.sha256("".join(a + b for a, b in siblings).encode() + end).hexdigest())
            now = changed or leaf
            for a, b in siblings + higher:
                now = hashlib.sha256((a + now + b).encode()).hexdigest()
            folded.append(now)
        m = own.num_rows
        return pa.table({"id": own["id"], "leaf": digests, "subroot": [above["top"][0].as_py()] * m, "root": [root] * m, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]}, schema=schema)

    blocks = nodes.select("key", "id", "digest", "found", "pos", "n").groupBy("key", F.expr(f"pos div {size}"))
    out = blocks.cogroup(path.groupBy("key", "pos")).applyInArrow(prove, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
