"""Packing documents into sequences by vector best-fit.

Documents become token pieces of at most a sequence's length.  What must be planned is only how many pieces there are of each
length, a histogram no larger than a sequence is long: lengths go, longest first, to the open bins they fit best, by the weighted dot product
of the piece's demands with a bin's free tokens, free places and free attention cost (or by the norm of what would be left), and never beyond any of them.  Bins with equal free
capacities are one class with a count, so the plan doesn't grow with the corpus.  Spark then ranks the pieces of each length and deals them
to the planned places; ranks are sums over buckets, of which a length has as many as its pieces need, so a length that a third of all pieces has is never in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

#: Pieces of a length that are ranked in one go, about.
RANKED = 1 << 15
#: Words that are encoded in one go, with blanks between.
ENCODED = 1024
#: Words whose ids a worker keeps, and ids of all of them.
CACHED, IDS = 1 << 20, 1 << 23
#: Bytes of texts that a worker gets at once, and of those that it takes apart in one go.
BATCH, SLICE = "4m", 1 << 20
_TOKENIZERS: dict[str, object] = {}


class _Cache:
    """Token ids by word hash: hashes in order, and the place of each word's ids in one array."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.keys, self.pool, self.begin, self.many = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes, and which of them are known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray):
        self.keys = np.concatenate([self.keys, keys])
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.begin = np.concatenate([self.begin, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])[order]
        self.many = np.concatenate([self.many, n.astype(np.int32)])[order]
        self.pool = np.concatenate([self.pool, ids])


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        _TOKENIZERS[path] = (t, _Cache())
    return _TOKENIZERS[path]


def _forget() -> None:
    """A worker that lives on holds no tokenizers and no words any more."""
    _TOKENIZERS.clear()


def token_ids(flat: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts, end to end, and how many each has.

    The tokenizer drops white space and no token crosses it, so each distinct word between ASCII white space is encoded once, many of them as one text
    whose tokens' places tell the words apart; a worker keeps the ids of about CACHED words by their 64-bit hash.
    """
    tokenizer, cache = _tokenizer(path)
    start, length, h, counts = tb.words(flat, off, lower=False)
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
    kinds, first, which = np.unique(h, return_index=True, return_inverse=True)
    if len(cache.keys) > CACHED or len(cache.pool) > IDS:
        cache.clear()
    new = np.flatnonzero(~cache.find(kinds)[1])
    if len(new):
        raw = flat.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), (start + length)[first[new]].tolist(), strict=True)]
        ids, many = [], []
        for i in range(0, len(texts), ENCODED):
            part = texts[i : i + ENCODED]
            e = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            of = np.searchsorted(ends, np.fromiter((a for a, _ in e.offsets), np.int64), side="right")
            ids.append(np.array(e.ids, np.uint32))
            many.append(np.bincount(of, minlength=len(part)))
        cache.add(kinds[new], np.concatenate(ids), np.concatenate(many))
    at = cache.find(kinds)[0]
    pool, begin, n = cache.pool, cache.begin[at].astype(np.int64), cache.many[at].astype(np.int64)
    many = n[which]
    out = pool[np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
    return out, np.diff(ends)


def _pieces(path: str, most: int, end_id: int):
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        for batch in batches:
            flat, off = tb.flat_column(batch.column(1))
            for a, b in tb.slices(off, SLICE, 1 << 14):
                o = off[a : b + 1]
                ids, counts = token_ids(flat[o[0] : o[-1]], o - o[0], path)
                at, rows = 0, ([], [], [], [], [])
                for i, n in enumerate(counts.tolist()):
                    doc = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, s in enumerate(range(0, len(doc), most)):
                        part = doc[s : s + most]
                        for c, v in zip(rows, (a + i, k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                            c.append(v)
                own = batch.column(0).take(pa.array(rows[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=names)

    return run


def best_fit(histogram: dict[int, int], capacity: int, max_docs: int | None = None, max_cost: int | None = None, weights=(1.0, 0.25, 0.25), score: str = "dot") -> list[tuple[int, list[int]]]:
    """Bins for so many pieces of each length: (how many such bins, their lengths in order).

    ``max_cost`` bounds the sum of squared lengths of a bin (its attention within documents).  A piece that alone is beyond a limit gets a
    bin of its own.  score: "dot" takes the bin whose fill, after the piece, has the largest
    weighted dot product with the piece's demand (all as shares of the limits), "norm" the one with the least weighted norm of what is left.
    """
    docs, cost = max_docs or 1 << 40, max_cost or 1 << 60
    limits = np.array([capacity, docs, cost], float)
    w = np.array(weights) * np.array([1.0, max_docs is not None, max_cost is not None])
    free = np.zeros((0, 3), np.int64)
    count: list[int] = []
    content: list[tuple] = []  # linked lists: (length, how many, the rest)
    out: list[tuple[int, tuple]] = []

    def put(state, n, what):
        nonlocal free
        free = np.vstack([free, np.array([state], np.int64)])
        count.append(n)
        content.append(what)

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left, need = histogram[length], np.array([length, 1, length * length], np.int64)
        while left:
            fit = np.flatnonzero((free >= need).all(axis=1) & (np.array(count, np.int64) > 0)) if len(free) else []
            if len(fit):
                after = (free[fit] - need) / limits
                value = -(w * after**2).sum(axis=1) if score == "norm" else (w * (1 - after) * (need / limits)).sum(axis=1)
                i = int(fit[np.argmax(value)])
                # a bin takes as many of this length as it can while it stays the fullest: that is what best fit would do one by one
                each = int(max(1, min(np.min(free[i] // need), left)))
                n = min(count[i], left // each)
                count[i] -= n
                put(free[i] - each * need, n, (length, each, content[i]))
                left -= n * each
            else:
                each = int(max(1, min(np.min(np.array([capacity, docs, cost], np.int64) // need), left)))
                n = max(1, left // each)
                put(np.array([capacity, docs, cost], np.int64) - each * need, n, (length, each, ()))
                left -= n * each
        # full bins, and bins that no shorter piece can fit, leave the search
        done = [i for i, n in enumerate(count) if n and (free[i] < np.array([1, 1, 1])).any()]
        if done or len(count) > 4096:
            for i in done:
                out.append((count[i], content[i]))
                count[i] = 0
            keep = [i for i, n in enumerate(count) if n]
            free, count, content = free[keep], [count[i] for i in keep], [content[i] for i in keep]
    out += [(n, c) for n, c in zip(count, content, strict=True) if n]
    bins = []
    for n, c in out:
        lengths = []
        while c:
            lengths = [c[0]] * c[1] + lengths
            c = c[2]
        bins.append((n, lengths))
    return bins


def places(bins: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each length, in the order of its pieces' ranks: runs of places (length, first rank, first sequence, offset)."""
    rows, rank, base = [], {}, 0
    for n, lengths in bins:
        at = 0
        for x in lengths:
            rows.append((x, rank.get(x, 0), base, at))
            rank[x] = rank.get(x, 0) + n
            at += x
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": table[:, 0] * (1 << 44) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    max_docs: int | None = None,
    max_cost: int | None = None,
    score: str = "dot",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and ``end_id``; null and empty texts are the end alone.  Documents longer than ``capacity`` are cut into
    pieces of that length and a last one.  ``max_docs`` and ``max_cost`` (sum of squared lengths) limit a sequence as well if given.  Rows that repeat an
    id are documents of their own, with pieces of their own.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    pieces = source.mapInArrow(_pieces(tokenizer_path, capacity, end_id), schema)
    # equal pieces of repeated rows may change places with each other: any order does, if it stays as it was written
    pieces = common.stage(pieces, "pieces", BATCH)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(places(best_fit(histogram, capacity, max_docs, max_cost, score=score)))
    buckets = spark.createDataFrame([(n, -(-many // RANKED)) for n, many in histogram.items()], "length long, buckets long")
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.col("buckets"))).drop("buckets")

    per = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    per = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    per = common.stage(per, "lengths")

    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece"))
    ranked = pieces.withColumn("within", within - 1).join(per.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))

    def place(batches):
        p = plan.value
        _forget()  # all is encoded by now
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            i = np.searchsorted(p["key"], length * (1 << 44) + rank, side="right") - 1
            yield pd.DataFrame({**{c: pdf[c] for c in ("id", "piece", "start", "length", "ids_crc32")}, "sequence_id": p["sequence"][i] + rank - p["rank"][i], "offset": p["offset"][i]})

    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, f"{schema}, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
