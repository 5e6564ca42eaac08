"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Cells are split level by level: each cell with more residents than a block holds is trained on a bounded sample of its own, in a task of its own, and its vectors go to the cells that come of it, until
cells are small or a split costs more than it saves. So there are as many cells as the number of vectors asks for. Every vector has the cell of its nearest centroid as its home, and is a guest in each
cell to whose border it is so near that a linked vector could live there: vectors of cosine t are at most sqrt(2 - 2 t) apart, and so is
each of them from the plane between their cells.  That holds for residents and guests of the cell that is split alike, so no level loses a pair.  Within a cell and label, vectors are dealt into blocks and each task multiplies one block of
residents with one block of residents and guests; it gives back counts and a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors in a block; about how many vectors, and numbers in them, the centroids of one cell are trained on; numbers in the vectors, guests' copies too, that a task gives out at once.
BLOCK, SAMPLE, SAMPLE_NUMBERS, PART_NUMBERS = 2048, 8192, 1 << 23, 1 << 20
#: Blocks to a side of what a task multiplies; the share of a block that can be multiplied with a vector while a copy of it is moved.
SIDE, COPY = 4, 0.25
#: Cells that come of one at most, and the share of its residents that a cell may keep if it is to be split once more.
CELLS, SHRINK = 256, 0.9


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of unit vectors; an emptied cell starts again at the vector that is worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        sims = x @ c.T
        home = sims.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        worst = np.argsort(sims.max(axis=1))
        for i, j in zip(np.flatnonzero(np.linalg.norm(total, axis=1) < 1e-9), worst, strict=False):
            total[i] = x[j]
        c = unit(total)
    return c


def visits(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and the matrix of the cells in which it is a guest."""
    sims = x @ c.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[home]
    guest = sims[np.arange(len(x)), home][:, None] - sims <= apart * reach + 1e-9
    guest[np.arange(len(x)), home] = False
    return home, guest


def choose_cells(x: np.ndarray, n: int, reach: float, most: int = CELLS, copy: float = COPY * BLOCK) -> np.ndarray:
    """Centroids with the least work over all n vectors: residents times residents and guests, in each cell, and the copies to be moved, each of which takes as long as ``copy`` products."""
    best, cost = unit(x[:1]), float(n) * n + copy * n
    k = 4
    while k <= min(most, len(x) // 20):
        c = spherical_kmeans(x, k)
        home, guest = visits(x, c, reach)
        own = np.bincount(home, minlength=k) * (n / len(x))
        new = float((own * (own + guest.sum(axis=0) * (n / len(x)))).sum()) + copy * n * (1 + guest.mean() * k)
        if new < cost:
            best, cost = c, new
        k *= 4
    return best


def _spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over index pairs by repeated minima: a star for every component."""
    nodes, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes[root], nodes
        root = new


_PLACED = "label string, cell string, home boolean, open boolean, parent long, rep long, cls long, n long, v array<double>"


def _whole(batches):
    """Unit vectors, all of one length in one cell; they are scaled by the largest component first: no overflow of squares."""
    for pdf in batches:
        for d, part in pdf.groupby(pdf["v"].map(len)):
            x = np.stack(part["v"].to_numpy()).astype(float)
            x = unit(x / np.abs(x).max(axis=1, keepdims=True))
            yield part.assign(cell=str(d), home=True, open=True, parent=2**62, v=list(x))[["label", "cell", "home", "open", "parent", "rep", "cls", "n", "v"]]


def _trained(reach: float, most: int, copy: float):
    """The centroids that a cell is split by, trained on its sample, and how many rows come of one by that; one centroid if no split is worth it."""

    def run(pdf):
        pdf = pdf.sort_values("cls")
        x = np.stack(pdf["v"].to_numpy())
        c = choose_cells(x, int(pdf["residents"].iloc[0]), reach, most, copy)
        copies = 1 + (visits(x, c, reach)[1].sum() / len(x) if len(c) > 1 else 0)
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "cell": pdf["cell"].iloc[:1], "copies": [float(copies)], "centroids": [[list(x) for x in c]]})

    return run


def _moved(reach: float):
    """A part of a cell's vectors in the cells that come of it: residents live in one, guests nowhere."""

    def run(pdf, trained):
        if not len(pdf):
            return pdf.drop(columns=["part", "residents"])
        out = pdf.assign(parent=pdf["residents"]).drop(columns=["part", "residents"])
        c = [np.asarray(x) for x in trained["centroids"].iloc[0]] if len(trained) else []
        if len(c) < 2:
            return out.assign(open=False)
        c = np.stack(c)
        x = np.stack(out["v"].to_numpy())
        seen = [visits(x[i : i + 1024], c, reach) for i in range(0, len(x), 1024)]  # bounded memory
        home, guest = (np.concatenate(part) for part in zip(*seen, strict=True))
        i, g = np.nonzero(guest)
        at, child = np.concatenate([np.arange(len(out)), i]), np.concatenate([home, g])
        lives = np.concatenate([out["home"].to_numpy(), np.zeros(len(i), bool)])
        out = out.iloc[at]
        return out.assign(home=lives, cell=[f"{a}/{b}" for a, b in zip(out["cell"], child, strict=True)])

    return run


def placed_in_cells(classes: DataFrame, reach: float) -> DataFrame:
    """Vectors (label, rep, cls, n, v) in cells: a row for the cell where each lives (home) and for each where it is a guest; staged.

    ``reach``: how far linked vectors are apart at most. Rows of a cell are dealt in parts, and centroids go to each part: neither a cell nor all centroids meet in one task.
    """
    placed = common.stage(classes.select("label", "rep", "cls", "n", "v").mapInPandas(_whole, _PLACED), "cells")
    while True:
        # placed may have cells that were closed; those that a split has hardly made smaller are left as they are
        sizes = placed.where("open").groupBy("label", "cell").agg(F.count_if("home").alias("residents"), F.count("*").alias("members"), F.max("parent").alias("parent"), F.max(F.size("v")).alias("d"))
        large = common.stage(sizes.where((F.col("residents") > BLOCK) & (F.col("residents") < F.col("parent") * SHRINK)).withColumn("at", F.struct("label", "cell")), "large")
        if large.isEmpty():
            common.discard(large)
            return placed
        of_cell = lambda dim, keep: common.spread_join(placed.withColumn("at", F.struct("label", "cell")), dim, "at", "members", "cls", keep).drop("at")
        take = F.greatest(F.lit(64), F.least(F.lit(SAMPLE), F.floor(SAMPLE_NUMBERS / F.col("d"))))
        sample = of_cell(large, ["residents", "d"]).where("home and residents is not null").where(F.pmod(F.xxhash64("cls", F.lit("sample")), F.col("residents")) < take).select("label", "cell", "residents", "cls", "v")
        trained = common.stage(sample.groupBy("label", "cell").applyInPandas(_trained(reach, CELLS, COPY * BLOCK), "label string, cell string, copies double, centroids array<array<double>>"), "centroids")
        # As many parts as what comes of a cell asks for: borders may be so wide that a vector is a guest in most cells.
        parts = F.ceil(F.col("members") * F.coalesce("copies", F.lit(1.0)) * F.col("d") / PART_NUMBERS).cast("int")
        before_parts, large = large, common.stage(large.join(trained.select("label", "cell", "copies"), ["label", "cell"], "left").withColumn("parts", parts), "large")
        common.discard(before_parts)
        rows = of_cell(large, ["residents", "parts"])
        splits = rows.where("residents is not null").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        dealt = trained.drop("copies").join(large.select("label", "cell", "parts"), ["label", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("parts")
        key = ["label", "cell", "part"]
        names = placed.columns
        moved = splits.select(*names, "part", "residents").groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(_moved(reach), _PLACED)
        before, placed = placed, common.stage(rows.where("residents is null").select(*names).union(moved.select(*names)), "cells")
        common.discard(before, large, trained)


def exploded(placed: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of the products' tasks and the columns that name a task: a cell's residents, in own_blocks, each meet all of its residents and guests, in blocks."""
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / (SIDE * BLOCK))).cast("int")
    sizes = placed.groupBy(F.struct("label", "cell").alias("at")).agg(F.count("*").alias("members"), parts(F.count_if("home")).alias("own_blocks"), parts(F.count("*")).alias("blocks"))
    dealt = common.spread_join(placed.withColumn("at", F.struct("label", "cell")), sizes, "at", "members", "cls", ["own_blocks", "blocks"], total=placed.count())
    at = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    row_side = dealt.where("home").withColumns({"i": at("own_blocks"), "j": F.explode(F.expr("sequence(0, blocks - 1)")), "side": F.lit(0)})
    col_side = dealt.withColumns({"j": at("blocks"), "i": F.explode(F.expr("sequence(0, own_blocks - 1)")), "side": F.lit(1)})
    key = ["label", "cell", "i", "j"]
    return row_side.select(*key, "side", "rep", "n", "v").union(col_side.select(*key, "side", "rep", "n", "v")), key


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Rows are linked when their labels are equal and not null (all rows, if ``label_col`` is None) and the cosine of their vectors, in double
    precision, is at least ``threshold``.  Null, empty and zero vectors, those with null or non-finite components and rows with a null label link with nothing and are kept.  Vectors of
    different lengths aren't linked.  Rows with equal vector and label, repeated ones too, are one class that is compared once and counts as often as it has rows.
    A null id is never kept in a class.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    label = F.lit(0) if label_col is None else F.col(label_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.expr("label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    rows = rows.withColumn("good", F.coalesce(finite, F.lit(False)))
    classes = rows.where("good").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("cls", F.xxhash64("label", "v"))
    classes = common.stage(classes, "classes")
    placed = placed_in_cells(classes.where("rep is not null"), float(np.sqrt(max(0.0, 2 - 2 * threshold))))
    tasks, key = exploded(placed)

    def products(pdf):
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"rep": [], "links": [], "a": []})
        x, y = np.stack(a["v"].to_numpy()), np.stack(b["v"].to_numpy())
        ra, rb, nb = a["rep"].to_numpy(), b["rep"].to_numpy(), b["n"].to_numpy()
        links, ii, jj = np.zeros(len(a), np.int64), [], []
        for s in range(0, len(a), 256):  # bounded memory
            hit = x[s : s + 256] @ y.T >= threshold
            hit &= ra[s : s + 256, None] != rb[None, :]
            links[s : s + 256] = hit @ nb
            i, j = np.nonzero(hit)
            if len(i):
                roots, nodes = _spanning(ra[i + s], rb[j])
                ii.append(roots)
                jj.append(nodes)
        edges = pd.DataFrame({"rep": np.concatenate(jj), "links": -1, "a": np.concatenate(ii)}) if ii else pd.DataFrame({"rep": [], "links": [], "a": []})
        counted = links > 0
        return pd.concat([pd.DataFrame({"rep": ra[counted], "links": links[counted], "a": -1}), edges[edges["rep"] != edges["a"]]]).astype("int64")

    found = common.stage(tasks.groupBy(*key).applyInPandas(products, "rep long, links long, a long"), "links")
    counts = found.where("links >= 0").groupBy("rep").agg(F.sum("links").alias("links"))
    parts = common.components(found.where("links < 0").select("a", F.col("rep").alias("b")).distinct())
    info = classes.select("label", "v", "rep", F.col("n").alias("copies")).join(counts, "rep", "left").join(parts.select(F.col("node").alias("rep"), "root"), "rep", "left")
    out = rows.withColumn("v", F.when(F.col("good"), F.col("v"))).join(info, ["label", "v"], "left")
    component = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.coalesce("root", "rep"))
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
