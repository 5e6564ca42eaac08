"""Near-duplicates among texts: SuperMinHash signatures, banding, verification on full shingle sets, union-find.

SuperMinHash gives every element of a set a random permutation of the signature's slots; the element offers slot p[j]
the value j + random. Ranks of one element are correlated (each of its values is in another slot), which lowers
the variance of the estimate, and no value of level j can matter once all slots hold values below j: there work on a set stops.

What is shuffled: a signature per document (some bits of each slot); band keys of one document per distinct shingle set; texts only of
candidates that their signatures don't rule out.
A group of equal sets is one class from the start.  In a bucket of the banding, members are compared with a few pivots; of those
that are then still in different components, pieces are held against each other in blocks. A pair is looked at in the first bucket that it has in common. Texts that have a
pair which neither distances to a pivot nor signatures rule out go to their block, once each however many such pairs they have, and are compared in full there.
So a group of n near copies costs a few times n comparisons, no row is made for a pair, and yet no link between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

_U = np.uint64
_FULL = _U(2**64 - 1)
# Owners of shingles are the leading 12 bits of a sorted key, so a hash keeps 52 bits.
#: Rounds in which each bucket's members are compared with one of them.
PIVOTS = 3
#: Texts that are compared with one text in one go; members and shingles of a piece of a bucket: two pieces at a time are held against each other.
PIECE, BLOCK, BLOCK_SHINGLES = 64, 512, 1 << 19
#: Standard errors by which a signature's estimate may be off: a linked pair is beyond them once in about 50 million.
UNSURE = 5.5


def distinct_sets(word_hash: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each of up to 4096 texts, ordered within each, and how many each has."""
    h, many = tb.shingles(word_hash, counts, size)
    key = np.sort((h >> _U(12)) | (np.repeat(np.arange(len(counts)), many).astype(_U) << _U(52)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    owner = (key >> _U(52)).astype(np.int64)
    return key & _U(2**52 - 1), np.bincount(owner, minlength=len(counts))


def superminhash(elements: np.ndarray, counts: np.ndarray, slots: int) -> np.ndarray:
    """Signatures, (sets, slots) of uint64: the level in the leading 16 bits, a random number below.  Empty sets: all ones."""
    n = len(counts)
    sig = np.full(n * slots, _FULL, _U)
    owner = np.repeat(np.arange(n), counts)

    def draw(e, level):
        x = tb.mix(e + _U((level + 1) * 0xD6E8FEB86659FD93 % 2**64))
        k = level + (((x & _U(0xFFFF)) * _U(slots - level)) >> _U(16)).astype(np.int64)
        return k, (x >> _U(16)) | (_U(level) << _U(48))

    def unfinished(level):
        # rows of sig whose largest value could still fall at the next level
        return sig.reshape(n, slots).max(axis=1) >= _U(level + 1) << _U(48)

    first, v = draw(elements, 0)
    np.minimum.at(sig, owner * slots + first, v)
    for level in range(1, slots):
        on = unfinished(level - 1)[owner]
        if level == 1:
            e, o, first = elements[on], owner[on], first[on]
            k, v = draw(e, 1)
            slot = np.where(k == first, 0, k)
            second = k
        else:
            if level == 2:
                e, o, first, second = e[on], o[on], first[on], second[on]
                row = np.arange(len(e))
                perm = np.tile(np.arange(slots, dtype=np.int16), (len(e), 1))
                for j, k in ((0, first), (1, second)):
                    swap = perm[row, k]
                    perm[row, k] = perm[:, j]
                    perm[:, j] = swap
            elif not on.all():
                e, o, perm = e[on], o[on], perm[on]
                row = row[: len(e)]
            k, v = draw(e, level)
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, level]
        if not len(e):
            break
        np.minimum.at(sig, o * slots + slot, v)
        owner = o
    return sig.reshape(n, slots)


def _signatures(size: int, bands: int, rows: int):
    slots, bits = bands * rows, _U(min(32, 64 // rows))
    field = (_U(1) << bits) - _U(1)

    def run(batches):
        for batch in batches:
            flat, off = tb.flat_column(batch.column(1))
            sizes, prints, keys = [], [], []
            for a, b in tb.slices(off):
                o = off[a : b + 1]
                _, _, wh, counts = tb.words(flat[o[0] : o[-1]], o - o[0])
                sets, many = distinct_sets(wh, counts, size)
                at = np.minimum(np.cumsum(many) - many, max(len(sets) - 1, 0))
                print_ = np.zeros((2, b - a), _U)
                if len(sets):
                    for i, salt in enumerate((0x51, 0xA7)):
                        print_[i] = np.where(many > 0, np.add.reduceat(tb.mix(sets + _U(salt)), at), _U(0))
                sig = superminhash(sets, many, slots).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), _U)
                for j in range(rows):
                    key = (key << bits) | (tb.mix(sig[:, :, j]) & field)
                sizes.append(many)
                prints.append(print_)
                keys.append(key)
            n = batch.num_rows
            many = np.concatenate(sizes) if n else np.zeros(0, np.int64)
            p = np.concatenate(prints, axis=1).view(np.int64) if n else np.zeros((2, 0), np.int64)
            k = np.concatenate(keys).view(np.int64).ravel() if n else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), pa.array(p[0]), pa.array(p[1]), lists], names=["id", "n_shingles", "p1", "p2", "bands"])

    return run


def _bounds(x: np.ndarray, y: np.ndarray, rows: int, unsure: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances of sets from the slots that their signatures, rows of x and y, have in common; none if ``unsure`` is None."""
    if unsure is None:
        return np.zeros(len(x)), np.ones(len(x))
    bits = min(32, 64 // rows)
    field, chance = _U((1 << bits) - 1), 2.0**-bits
    differs = x ^ y
    n = max(1, differs.shape[1] * rows)
    same = sum((((differs >> _U(bits * j)) & field) == 0).sum(axis=1) for j in range(rows)) / n
    bound = lambda e, sign: (e + unsure**2 / (2 * n) + sign * unsure * np.sqrt(e * (1 - e) / n + unsure**2 / (4 * n * n))) / (1 + unsure**2 / n)
    lo, hi = 1 - bound(same, 1), 1 - bound(np.maximum(same - chance, 0) / (1 - chance), -1)
    return np.maximum(lo, 0.0), np.minimum(hi, 1.0)


def _matrix(column, rows: int, kind=None) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return (flat.view(kind) if kind else flat).reshape(rows, -1)


def _estimate(rows: int, unsure: float | None):
    """Bounds of the distance of pairs (a, b)."""

    def run(batches):
        for batch in batches:
            lo, hi = _bounds(*(_matrix(batch.column(i), batch.num_rows, _U) for i in (2, 3)), rows, unsure)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo), pa.array(hi)], names=["a", "b", "lo", "hi"])

    return run


def _blocks(batches):
    """The rows of each block: they come sorted by (key, pa, pb)."""
    held = None  # the rows of the block that may go on in the next batch
    for batch in batches:
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ids = np.stack([now[c].to_numpy().astype(np.int64) for c in ("key", "pa", "pb")])
        cut = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cut[:-1]], cut, strict=False):
            yield now.slice(a, b - a).combine_chunks().to_batches()[0]
        held = now.slice(cut[-1] if len(cut) else 0)
    if held is not None and len(held):
        yield held.combine_chunks().to_batches()[0]


def _open_pairs(whole, num: int, den: int):
    """Members x and y of the two pieces of a block, and which of their pairs are in different components and of sizes that allow a link."""
    own, first, last, rep, n, root = (whole.column(c).to_numpy() for c in ("own", "pa", "pb", "rep", "n", "root"))
    x, y = np.flatnonzero(own == first[0]), np.flatnonzero(own == last[0])
    small, large = np.minimum(n[x][:, None], n[y]), np.maximum(n[x][:, None], n[y])
    on = (root[x][:, None] != root[y]) & (den * small >= num * large)
    if first[0] == last[0]:
        on &= rep[x][:, None] < rep[y]
    return x, y, on


def _still_open(rows: int, unsure: float | None, num: int, den: int, far: float):
    """Of the members of a block, those with a pair that pivots and signatures don't rule out and that has no bucket in common before this one."""

    def run(batches):
        for whole in _blocks(batches):
            x, y, on = _open_pairs(whole, num, den)
            lo, hi, sig = _matrix(whole["lo"], len(whole)), _matrix(whole["hi"], len(whole)), _matrix(whole["bands"], len(whole), _U)
            for i in range(lo.shape[1]):
                on &= (lo[x, i][:, None] - hi[y, i] <= far) & (lo[y, i] - hi[x, i][:, None] <= far)
            for i in range(whole["i"][0].as_py()):
                on &= sig[x, i][:, None] != sig[y, i]
            i, j = np.nonzero(on)
            left = np.zeros(len(whole), bool)
            for a in range(0, len(i), 1 << 14):
                u, v = x[i[a : a + (1 << 14)]], y[j[a : a + (1 << 14)]]
                near = _bounds(sig[u], sig[v], rows, unsure)[0] <= far
                left[u[near]] = left[v[near]] = True
            if left.any():
                yield whole.select(["key", "pa", "pb", "own", "rep", "n", "root"]).filter(pa.array(left))

    return run


def _settle(size: int, num: int, den: int):
    """Links between members of a block, as far as they join components, from the full sets of their texts."""

    def run(batches):
        for whole in _blocks(batches):
            flat, off = tb.flat_column(whole["text"])
            sets, many = [], []
            for a, b in tb.slices(off):
                o = off[a : b + 1]
                _, _, wh, counts = tb.words(flat[o[0] : o[-1]], o - o[0])
                for out, got in zip((sets, many), distinct_sets(wh, counts, size), strict=True):
                    out.append(got)
            which = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
            many = np.concatenate(many)
            end = np.cumsum(many)
            x, y, on = _open_pairs(whole, num, den)
            rep, root = whole["rep"].to_numpy(), whole["root"].to_numpy().copy()
            of_y = np.concatenate([which[end[j] - many[j] : end[j]] for j in y.tolist()])
            first = np.cumsum(many[y]) - many[y]
            mark = np.zeros(int(which.max(initial=-1)) + 1, bool)
            links = ([], [])
            for i in np.flatnonzero(on.any(axis=1)).tolist():
                u = x[i]
                own = which[end[u] - many[u] : end[u]]
                mark[own] = True
                both = np.add.reduceat(mark[of_y], first, dtype=np.int64)
                mark[own] = False
                for v in y[on[i] & (den * both >= num * (many[u] + many[y] - both))].tolist():
                    if root[u] != root[v]:
                        root[root == root[v]] = root[u]
                        links[0].append(min(rep[u], rep[v]))
                        links[1].append(max(rep[u], rep[v]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in links], names=["a", "b"])

    return run


def _compare(size: int, num: int, den: int):
    """Distance of the shingle sets of texts b to the text a that comes before them; linked if den * intersection >= num * union."""

    def run(batches):
        held = np.zeros(0, _U)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat, off = tb.flat_column(batch.column(2))
            out = []
            for x, y in tb.slices(off):
                o = off[x : y + 1]
                _, _, wh, counts = tb.words(flat[o[0] : o[-1]], o - o[0])
                sets, many = distinct_sets(wh, counts, size)
                for i, s in zip(range(x, y), np.split(sets, np.cumsum(many)[:-1]), strict=True):
                    if b[i] is None:
                        held = s
                        continue
                    both = np.concatenate([held, s])
                    both.sort(kind="stable")
                    common_ = int((both[1:] == both[:-1]).sum())
                    union = len(both) - common_
                    out.append((a[i], b[i], 1 - common_ / max(union, 1), len(held) > 0 and len(s) > 0 and den * common_ >= num * union))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["a", "b", "distance", "linked"])

    return run


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: tuple[int, int] = (80, 100),
    shingle: int = 5,
    rows: int = 8,
    unseen: float = 1e-5,
    unsure: float | None = UNSURE,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), kept.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a text's set has its distinct shingles of five words, one shingle if it has
    fewer words, and none without words (null, empty and blank texts: component_id is the row's id, kept).  Texts are linked when
    den * intersection >= num * union.  A band has ``rows`` slots, and there are so many bands that a pair just
    at the threshold goes unseen by all of them with probability ``unseen`` at most.  ``unsure``: standard errors by which a signature must be beyond the threshold to rule a pair out; None compares
    all pairs of a bucket in full.  Ids are integers and should be unique: rows that repeat one are compared by one of their texts.
    A row with a null id gets the component of its set and isn't kept.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    num, den = threshold
    bands = max(1, math.ceil(math.log(unseen) / math.log1p(-min(0.999999, num / den) ** rows)))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_shingles long, p1 long, p2 long, bands array<long>"
    sigs = common.stage(source.mapInArrow(_signatures(shingle, bands, rows), schema), "signatures")
    kind = ["n_shingles", "p1", "p2"]
    classes = sigs.where("n_shingles > 0").groupBy(*kind).agg(F.min("id").alias("rep"), F.first("bands").alias("bands")).where("rep is not null")
    classes = common.stage(classes, "classes")

    keys = classes.select("rep", F.posexplode("bands").alias("i", "band"), F.col("n_shingles").alias("n")).select("rep", "i", F.xxhash64("i", "band").alias("key"), "n")
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    none = F.array().cast("array<double>")
    state = keys.join(shared, "key").withColumn("company", F.sum("members").over(Window.partitionBy("rep")))
    state = state.withColumns({"root": F.col("rep"), "first_root": F.lit(-1).cast("long"), "pivots": F.array().cast("array<long>"), "lo": none, "hi": none})
    state = common.stage(state, "members")
    # Texts of all that share a bucket.  Merged at every size: how many these are grows with the corpus.
    texts = common.stage(source.join(state.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    far = 1 - num / den + 1e-9  # the largest distance of linked sets
    sizes_fit = "{d} * least({x}, {y}) >= {n} * greatest({x}, {y})"  # else the sizes alone forbid a link

    def confirmed(open_: DataFrame) -> DataFrame:
        """Distances of pairs (a, b) on their full sets: a text goes once to each piece of the pairs that it leads."""
        pieces = open_.groupBy("a").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        dealt = open_.join(pieces, "a").select("a", F.pmod(F.xxhash64("b"), F.col("pieces")).alias("piece"), "b")
        heads = dealt.select("a", "piece").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "text", "piece")
        others = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "text", "piece")
        rows_ = heads.union(others).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first()).select("a", "b", "text")
        exact = rows_.mapInArrow(_compare(shingle, num, den), "a long, b long, distance double, linked boolean")
        return exact.select("a", "b", F.col("distance").alias("lo"), F.col("distance").alias("hi"), "linked")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with bounds of the distance of their sets, and whether they are linked; texts are read where signatures leave it open."""
        slots = lambda x: classes.select(F.col("rep").alias(x), F.col("bands").alias(f"bands_{x}"))
        both = pairs.join(slots("a"), "a").join(slots("b"), "b").select("a", "b", "bands_a", "bands_b")
        guess = common.stage(both.mapInArrow(_estimate(rows, unsure), "a long, b long, lo double, hi double"), "estimates")
        exact = confirmed(guess.where(F.col("lo") <= far).select("a", "b"))
        out = common.stage(exact.union(guess.where(F.col("lo") > far).withColumn("linked", F.lit(False))), "compared")
        common.discard(pairs, guess)
        return out

    # Rounds of one pivot per bucket: the member with most company in all its buckets, then such a one outside the first pivot's component.
    # Buckets of one group agree on such a member, so that most pairs of a document are one and the same.
    links = found = None
    for round_ in range(PIVOTS):
        fresh = F.lit(True) if not round_ else F.expr("root != first_root and not array_contains(pivots, rep)")
        pivot = state.where(fresh).groupBy("key").agg(F.min(F.struct(-F.col("company"), "rep", "n")).alias("p")).select("key", F.col("p.rep").alias("a"), F.col("p.n").alias("m"))
        now = round_rows = common.stage(state.join(pivot, "key"), "round")  # buckets without a fresh member have nothing left to compare
        pairs = now.where(F.expr(f"rep != a and not array_contains(pivots, rep) and {sizes_fit.format(d=den, n=num, x='n', y='m')}")).select("a", F.col("rep").alias("b")).distinct()
        got = compared(common.stage(pairs, "pairs"))
        more = got.where("linked").select("a", "b")
        links = more if links is None else links.union(more)
        common.discard(found)
        found = common.stage(common.components(links), "components")
        least = F.when(F.col("rep") == F.col("a"), 0.0).otherwise(F.coalesce("near", 1 - F.least("n", "m") / F.greatest("n", "m")))
        most = F.when(F.col("rep") == F.col("a"), 0.0).otherwise(F.coalesce("distant", F.lit(1.0)))
        now = now.join(got.select("a", F.col("b").alias("rep"), F.col("lo").alias("near"), F.col("hi").alias("distant")), ["a", "rep"], "left")
        now = now.withColumns({"pivots": F.array_append("pivots", F.col("a")), "lo": F.array_append("lo", least), "hi": F.array_append("hi", most)})
        now = now.withColumn("of", F.col("pivots")[0]).drop("root", "first_root", "a", "m", "near", "distant")
        now = now.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").join(found.select(F.col("node").alias("of"), F.col("root").alias("first_root")), "of", "left")
        now = now.withColumns({"root": F.coalesce("root", "rep"), "first_root": F.coalesce("first_root", "of")}).drop("of")
        done, state = (state, round_rows), common.stage(now, "members")
        common.discard(*done)

    # What is still apart within a bucket, unless distances to a pivot tell that no link is possible (Jaccard distance is a metric).
    open_ = state.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    apart = state.join(open_, "key").where("not array_contains(pivots, rep)").join(classes.select("rep", "bands"), "rep")
    pieces = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    apart = apart.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    blocks = apart.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)"))).withColumns({"pa": F.least("own", "other"), "pb": F.greatest("own", "other")})
    sorted_ = lambda t: t.repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb")
    blocks = sorted_(blocks.select("key", "pa", "pb", "own", "i", "rep", "n", "root", "lo", "hi", "bands"))
    left = "key long, pa int, pb int, own int, rep long, n long, root long"
    rest = common.stage(blocks.mapInArrow(_still_open(rows, unsure, num, den, far), left), "rest")
    common.discard(state)
    if not rest.isEmpty():
        met = sorted_(rest.join(texts.withColumnRenamed("id", "rep"), "rep").select("key", "pa", "pb", "own", "rep", "n", "root", "text"))
        more = common.stage(met.mapInArrow(_settle(shingle, num, den), "a long, b long").distinct(), "settled")
        if not more.isEmpty():
            common.discard(found)
            found = common.stage(common.components(links.union(more)), "components")
    common.discard(texts, rest)

    root = classes.drop("bands").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*kind, F.coalesce("root", "rep").alias("root"))
    out = sigs.drop("bands").join(root, kind, "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
