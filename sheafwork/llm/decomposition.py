"""Packing without padding by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many of the longest length as there are, then the binary digits of what is left, longest first.
Every piece is a sequence of its own, so no sequence crosses documents, and sequences of one length make up a bucket from which batches without padding are drawn. Nothing
about one document depends on another: it is one map over the rows, without a shuffle, however large a corpus is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing
from . import textbytes as tb

#: Segments that are encoded in one go, and the segments whose ids a worker keeps.
ENCODED, CACHED = 1024, 1 << 20
#: What a cut at ASCII white space may not be near to: other white space, and strings that may be special tokens.
_WHOLE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"<|")
_CACHES: dict[str, packing._Cache] = {}


def segments(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments that a byte-level tokenizer treats each for itself, none of them empty: where each begins, and how many each text has.

    The tokenizer joins one blank to the word behind it; of white space between words all but the last character is one piece, the last one another, and white space at the
    end is one piece. So a text can be cut before a blank that a word follows, before a word behind other white space, and before and before the end of white space. Texts with other
    than ASCII white space, or with what may be a special token, are one segment each.
    """
    n = len(flat)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    space = tb._IS_SPACE[flat]
    first = np.zeros(n, bool)
    first[off[:-1][off[:-1] < off[1:]]] = True
    last = np.zeros(n, bool)
    last[off[1:][off[:-1] < off[1:]] - 1] = True
    before = np.concatenate([[False], space[:-1]]) & ~first
    after = np.concatenate([space[1:], [True]]) | last
    blank = np.concatenate([[False], flat[:-1] == 0x20])
    begins = first | (space & ~before) | (space & ~after) | (~space & before & ~blank)
    raw = None
    for mark in _WHOLE:
        if not (flat == mark[0]).any():
            continue
        raw = flat.tobytes() if raw is None else raw
        at = raw.find(mark)
        while at >= 0:
            i = int(np.searchsorted(off, at, side="right")) - 1
            begins[off[i] + 1 : off[i + 1]] = False
            at = raw.find(mark, int(off[i + 1]))
    start = np.flatnonzero(begins)
    return start, np.diff(np.searchsorted(start, off))


def _encode(tokenizer, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of segments, and how many each has.  Words behind one blank make up a text as they are; words without one are set apart by line ends, a token each."""
    ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    kinds: tuple[list[int], ...] = ([], [], [])
    for i, t in enumerate(texts):
        plain = not any(c.isspace() for c in t[1:]) and "<|" not in t
        kinds[0 if plain and len(t) > 1 and t[0] == " " else 1 if plain and not t[0].isspace() else 2].append(i)
    for kind, end in ((kinds[0], ""), (kinds[1], "\n")):
        for k in range(0, len(kind), ENCODED):
            part = kind[k : k + ENCODED]
            own = [texts[i] + end for i in part]
            e = tokenizer.encode("".join(own), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
            of = np.searchsorted(ends, np.fromiter((a for a, _ in e.offsets), np.int64), side="right")
            cuts = np.searchsorted(of, np.arange(len(part) + 1))
            all_ids = np.array(e.ids, np.uint32)
            for j, i in enumerate(part):
                ids[i] = all_ids[cuts[j] : cuts[j + 1] - len(end)]
    for i in kinds[2]:
        ids[i] = np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
    return ids, np.fromiter(map(len, ids), np.int64, len(ids))


def token_ids(flat: np.ndarray, off: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of texts, end to end, and how many each has; each distinct segment is encoded once and kept by its 64-bit hash."""
    tokenizer, cache = packing._tokenizer(path)[0], _CACHES.setdefault(path, packing._Cache())
    start, counts = segments(flat, off)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
    length = np.diff(np.append(start, len(flat)))
    kinds, first, which = np.unique(tb.segment_hash(flat, length), return_index=True, return_inverse=True)
    if len(cache.keys) > CACHED:
        cache.clear()
    new = np.flatnonzero(~cache.find(kinds)[1])
    if len(new):
        raw = flat.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), (start + length)[first[new]].tolist(), strict=True)]
        ids, many = _encode(tokenizer, texts)
        cache.add(kinds[new], np.concatenate(ids), many)
    at = cache.find(kinds)[0]
    begin, n = cache.begin[at], cache.many[at]
    many = n[which]
    out = cache.pool[np.repeat(begin[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
    ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(counts)])]
    return out, np.diff(ends)


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as powers of two, longest first: ``longest`` as often as it goes in, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def decompose(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (0: a piece is a whole sequence), with ``keep_ids`` also ids.

    A document is its token ids and ``end_id``; null and empty texts are the end alone.  ``longest`` is a power of two and the length of the longest sequence.  The length names the
    bucket.  Sequence numbers are unique, not gapless: a task's number and a counter.  Rows that repeat an id, and rows with a null id, are documents of their own, with pieces of
    their own.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"longest is no power of two: {longest}")
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        task, made = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            flat, off = tb.flat_column(batch.column(1))
            for a, b in tb.slices(off, 1 << 21, 1 << 14):
                o = off[a : b + 1]
                ids, counts = token_ids(flat[o[0] : o[-1]], o - o[0], tokenizer_path)
                at, rows = 0, ([], [], [], [], [])
                whole = []
                for i, n in enumerate(counts.tolist()):
                    doc = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    s, raw = 0, doc.tobytes()
                    for size in binary_lengths(n + 1, longest):
                        for c, v in zip(rows, (a + i, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), n + 1), strict=True):
                            c.append(v)
                        s += size
                    whole.append(doc)
                m = len(rows[0])
                columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:]), pa.array(np.arange(m) + (task + made)), pa.array(np.zeros(m, np.int64))]
                if keep_ids:  # pieces of a document follow each other, so all ids stand end to end
                    ends = np.concatenate([[0], np.cumsum(rows[2])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(whole).astype(np.int32))))
                made += m
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def write_buckets(pieces: DataFrame, folder: str, tokens_per_file: int = 1 << 26) -> DataFrame:
    """Sequences (with their ids) written as Parquet, a folder for each length, and read back: a batch drawn from one folder has no padding.

    A bucket has as many files as its tokens need, whatever share of all sequences it holds. There are no more lengths than binary digits of the longest.
    """
    tokens = {r.length: r.tokens for r in pieces.groupBy("length").agg(F.sum("length").alias("tokens")).collect()}
    ways = {n: -(-t // tokens_per_file) for n, t in tokens.items()}
    way = F.lit(1)
    for n, w in ways.items():
        way = F.when(F.col("length") == n, F.lit(w)).otherwise(way)
    dealt = pieces.repartition(max(1, sum(ways.values())), "length", F.pmod(F.xxhash64("sequence_id"), way))
    dealt.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(folder)
    return pieces.sparkSession.read.parquet(folder)
