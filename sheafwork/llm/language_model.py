"""Scoring texts by an n-gram model with deleted interpolation.

Maximum-likelihood estimates of all orders are mixed with weights that depend on how frequent the context is. The weights are learnt by
expectation-maximisation on held-out counts: every training token is held out of the counts in turn (its n-gram and context count one less).

Documents are dealt to chunks. A chunk sends each of its distinct n-grams once, as a hash with its training count, to the shard of that hash; the
shard adds up and answers with the total counts in the chunk's own order. So a frequent n-gram costs a shard one entry per chunk, nothing is
joined token by token, and what is gathered grows with the corpus. Every order from trigrams up has a pass of its own, after that of
the one before; there a chunk sends no n-gram of which a shorter part stands in no other chunk (so does the n-gram, and its total is the chunk's own count) or
never occurs in training. The sufficient statistics of the weights are a histogram of bounded size: for them alone, estimates are rounded to quarter powers of two; scores use
unrounded estimates. A chunk sends a row to every shard that it has n-grams for, never more rows than n-grams.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

_U = np.uint64
_END, _BEGIN = _U(0xE4D0E4D0E4D0E4D0), _U(0xBE61BE61BE61BE61)
#: Text bytes of a chunk, and steps per factor of two in the statistics of the weights.
CHUNK, STEPS = 6 << 20, 4


@dataclass
class Grams:
    keys: list[np.ndarray]  # for each order, the hash that ends at every place
    real: np.ndarray  # places that are tokens, not beginnings
    doc: np.ndarray
    docs: int
    starts: np.ndarray  # places that are the first of a text


def grams(texts, order: int, levels: int | None = None) -> Grams:
    """Hashes of the n-grams of texts, of all orders or the first ``levels``; each text is led by order - 1 beginnings and followed by one end."""
    flat, off = tb.flatten(texts)
    hashes, counts = [], []
    for a, b in tb.slices(off):
        _, _, h, c = tb.words(flat[off[a] : off[b]], off[a : b + 1] - off[a])
        hashes.append(h)
        counts.append(c)
    word, counts = np.concatenate(hashes), np.concatenate(counts)
    pad = max(1, order - 1)
    doc = np.repeat(np.arange(len(counts)), counts + pad + 1)
    first = np.cumsum(counts + pad + 1) - (counts + pad + 1)
    place = np.arange(len(doc)) - first[doc]
    seq = np.full(len(doc), _BEGIN, _U)
    real = place >= pad
    last = place == (counts + pad)[doc]
    seq[last] = _END
    seq[real & ~last] = word
    keys = [tb.mix(seq)]
    for _ in range((levels or order) - 1):
        longer = np.zeros_like(seq)  # what lies before a text counts as a beginning
        longer[1:] = keys[-1][:-1]
        longer[place == 0] = _BEGIN
        keys.append(tb.mix(longer * _U(0x9E3779B97F4A7C15) + seq))
    return Grams(keys, real, doc, len(counts), place == 0)


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and which of them stands at every place."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(shards)) >> _U(32)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers, all lowest ones first: the zeros of small numbers lie together and compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _totals(g: Grams, train: np.ndarray, replies: pd.DataFrame | None, upto: int):
    """For each order below ``upto``: its distinct n-grams, the training counts in the chunk, which n-grams shards are asked for, each place's n-gram, and the total counts (none where not answered yet)."""
    whole = None
    for level, keys in enumerate(g.keys[:upto]):
        kinds, first, which = _kinds(keys)
        own = np.bincount(which, weights=train, minlength=len(kinds)).astype(np.int64)
        # Pairs are asked for in the pass of the words, when no totals are known.
        ask = np.ones(len(kinds), bool) if level < 2 else ~(whole[first] | (whole[first - 1] & ~g.starts[first]))
        total = None
        if replies is not None and level in replies:
            total, alone = own.copy(), np.ones(len(kinds), bool)
            total[ask], alone[ask] = replies[level]
            whole = (alone | (total == 0))[which]
        yield kinds, own, ask, which, total


def _read(replies: pd.DataFrame, order: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Answers of each order, in the order of the n-grams asked for: total counts, and whether no other chunk has the n-gram."""
    out, replies = {}, replies.sort_values(["level", "shard"])
    for level in range(order):
        own = replies[replies["level"] == level]
        counts = [_from_planes(c, _U) for c in own["counts"]]
        alone = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)) for x, c in zip(own["alone"], counts, strict=True)]
        out[level] = np.concatenate(counts or [np.zeros(0, _U)]).astype(np.int64), np.concatenate(alone or [np.zeros(0, np.uint8)]).astype(bool)
    return out


def _sender(order: int, levels: range, shards: int):
    return (lambda pdf: _send(pdf, None, order, levels, shards)), (lambda left, right: _send(left, right, order, levels, shards))


def _send(left: pd.DataFrame, right: pd.DataFrame | None, order: int, levels: range, shards: int) -> pd.DataFrame:
    rows = []
    if len(left):
        g = grams(left["text"], order, levels[-1] + 1)
        train = left["train"].to_numpy(bool)[g.doc]
        known = None if right is None else _read(right, levels[0])
        for level, (kinds, own, ask, _, _) in enumerate(_totals(g, train, known, levels[-1] + 1)):
            if level in levels:
                kinds, n = kinds[ask], own[ask].astype(np.uint32)
                edges = np.searchsorted(_shard(kinds, shards), np.arange(shards + 1))
                rows += [(int(left["chunk"].iloc[0]), level, s, _planes(np.diff(kinds[a:b], prepend=_U(0))), _planes(n[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return pd.DataFrame(rows, columns=["chunk", "level", "shard", "keys", "counts"])


def _total(pdf):
    keys = [np.cumsum(_from_planes(k, _U), dtype=_U) for k in pdf["keys"]]
    counts = [_from_planes(c, np.uint32) for c in pdf["counts"]]
    kinds, _, which = _kinds(np.concatenate(keys))
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(kinds)).astype(np.int64)
    begin = tb.mix(np.array([_BEGIN]))[0]
    known = (total > 0) & (kinds != begin)
    ends = np.cumsum([len(k) for k in keys])
    answers = [_planes(total[which[e - len(k) : e]].astype(_U)) for k, e in zip(keys, ends, strict=True)]
    single = (np.bincount(which, minlength=len(kinds)) == 1)[which]
    alone = [np.packbits(single[e - len(k) : e]).tobytes() for k, e in zip(keys, ends, strict=True)]
    n, v = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    n[0], v[0] = int(total[known].sum()), int(known.sum())
    return pd.DataFrame({"chunk": pdf["chunk"], "level": pdf["level"], "shard": pdf["shard"], "counts": answers, "alone": alone, "n": n, "v": v})


def _answers(g: Grams, train: np.ndarray, replies: pd.DataFrame) -> list[np.ndarray]:
    """For each order, the total count of the n-gram that ends at every place."""
    return [total[which] for _, _, _, which, total in _totals(g, train, _read(replies, len(g.keys)), len(g.keys))]


def _parts(counts: list[np.ndarray], n: int, v: int, less: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of all orders, (orders + 1, places), from the uniform one up, and the context's frequency bucket."""
    out = [np.full(len(counts[0]), 1 / (v + 1)), np.maximum(counts[0] - less, 0) / max(n - 1 if np.ndim(less) else n, 1)]
    context = np.zeros(len(counts[0]), np.int64)
    for level in range(1, len(counts)):
        context = np.zeros_like(context)
        context[1:] = counts[level - 1][:-1]
        context = np.maximum(context - less, 0)
        out.append(np.divide(np.maximum(counts[level] - less, 0), context, out=np.zeros(len(context)), where=context > 0))
    return np.stack(out), np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def expectation_maximisation(bucket: np.ndarray, parts: np.ndarray, weight: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (40 buckets, parts) that make weighted observations likeliest; every part keeps a share of one pseudo-count."""
    k = len(parts)
    lam = np.full((40, k), 1 / k)
    for _ in range(rounds):
        total = np.full((40, k), 1 / k)
        for a in range(0, len(bucket), 1 << 17):
            own = slice(a, a + (1 << 17))
            p = lam[bucket[own]].T * parts[:, own]
            p *= weight[own] / np.maximum(p.sum(axis=0), 1e-300)
            total += np.stack([np.bincount(bucket[own], weights=p[i], minlength=40) for i in range(k)], axis=1)
        lam = total / total.sum(axis=1, keepdims=True)
    return lam


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, add: float = 0.1, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score; scores are log10 probabilities.

    Tokens are words at ASCII white space, A-Z lower-cased, then one end; null and empty texts are the end alone.  ``train`` says which rows are learnt from.
    base_score: unigrams with ``add`` added to each count and one unseen word.  n_known: tokens that occur in training.  A context that never occurs in training has weights of its own (bucket 0).
    Repeated rows count as often as they are there.  Without training rows all tokens are alike.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    rows, chunks = common.chunked(docs, id_col, text_col, chunk_bytes, F.coalesce(train, F.lit(False)).alias("train"))
    rows = rows.withColumn("id", F.col("id").cast("string"))  # beside nulls, numbers would become floats in pandas
    wide, narrow = "chunk int, level int, shard int, keys binary, counts binary", "chunk int, level int, shard int, counts binary, alone binary, n long, v long"
    replies = None
    for levels in (range(min(order, 2)), *(range(i, i + 1) for i in range(2, order))):
        alone, answered = _sender(order, levels, chunks)
        if replies is None:
            sent = rows.groupBy("chunk").applyInPandas(alone, wide)
        else:
            known = replies.select("chunk", "level", "shard", "counts", "alone").groupBy("chunk")
            sent = rows.groupBy("chunk").cogroup(known).applyInPandas(answered, wide)
        more = common.stage(sent.groupBy("level", "shard").applyInPandas(_total, narrow), "replies")
        replies = more if replies is None else replies.union(more)
    first = replies.where("level = 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = first[0] or 0, first[1] or 0
    answers = replies.select("chunk", "level", "shard", "counts", "alone")

    def statistics(left, right):
        g = grams(left["text"], order)
        train = left["train"].to_numpy(bool)[g.doc]
        learn = g.real & train
        parts, bucket = _parts(_answers(g, train, right), n, v, np.ones(len(g.doc), np.int64))
        q = np.where(parts[1:, learn] > 0, np.round(STEPS * np.log2(np.maximum(parts[1:, learn], 1e-300))), -4000).astype(np.int64)
        fields = np.vstack([bucket[learn], -q])
        # five fields of 12 bits to a column
        codes = np.stack([sum(f << (12 * i) for i, f in enumerate(fields[j : j + 5])) for j in range(0, len(fields), 5)])
        order_ = np.lexsort(codes)
        codes = codes[:, order_]
        cut = np.flatnonzero(np.concatenate([[True], (codes[:, 1:] != codes[:, :-1]).any(axis=0)])) if len(order_) else order_
        return pd.DataFrame({c: x[cut] for c, x in zip(cell, codes, strict=True)} | {"n": np.diff(np.append(cut, len(order_)))})

    both = rows.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    cell = [f"c{j}" for j in range(0, order + 1, 5)]
    cells = both.applyInPandas(statistics, ", ".join(f"{c} long" for c in [*cell, "n"])).groupBy(*cell).agg(F.sum("n").alias("n"))
    table = common.stage(cells, "cells").toArrow()  # bounded: 40 buckets by steps
    if table.num_rows:
        codes = [table[c].to_numpy() for c in cell]
        parts = np.empty((order + 1, table.num_rows))
        parts[0] = 1 / (v + 1)
        for i in range(1, order + 1):
            q = codes[i // 5] >> (12 * (i % 5)) & 4095
            parts[i] = np.where(q == 4000, 0.0, 2.0 ** (-q / STEPS))
        lam = expectation_maximisation(codes[0] & 4095, parts, table["n"].to_numpy().astype(float))
    else:
        lam = np.full((40, order + 1), 1 / (order + 1))

    def scores(left, right):
        g = grams(left["text"], order)
        counts = _answers(g, left["train"].to_numpy(bool)[g.doc], right)
        parts, bucket = _parts(counts, n, v, 0)
        p = np.log10((lam[bucket].T * parts).sum(axis=0))
        base = np.log10((counts[0] + add) / (n + add * (v + 1)))
        sums = lambda x: np.bincount(g.doc[g.real], weights=x[g.real], minlength=g.docs)
        return pd.DataFrame({"id": left["id"], "n_tokens": sums(np.ones(len(g.doc))).astype(np.int64), "n_known": sums(counts[0] > 0).astype(np.int64), "train_tokens": n, "base_score": sums(base), "score": sums(p)})

    out = both.applyInPandas(scores, "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
