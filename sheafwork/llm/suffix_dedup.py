"""Removing passages that repeat across documents, by suffix arrays built with induced sorting.

A string of ``least`` bytes that stands in two documents has in both the same anchor: the k bytes with the smallest hash among all that it holds, the leftmost of equal ones.
So documents are cut to the surroundings of their anchors, and those of anchors that stand in two documents or more go to the shard of the anchor's hash. A shard builds suffix arrays of
its distinct surroundings, part by part: suffixes are classified, leftmost-smaller substrings sorted and named, the reduced string sorted, and the array induced from it.
Common prefixes of neighbours are computed in the text's order (permuted); neighbours that share ``least`` bytes are occurrences of one string, and the smallest document among them keeps it.
A surrounding that stands several times in a chunk goes to the shard once. Anchors that very many documents have are dealt string by string, so that no shard grows with how often one phrase is used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textbytes as tb

_U = np.uint64
#: Text bytes of a chunk, of surroundings' text that a shard is meant for, and of one suffix array (which takes some hundred times its text's memory).
CHUNK, SHARD, PART = 4 << 20, 2 << 20, 1 << 19
#: Documents that may have an anchor before its strings are dealt one by one.
HOT = 2048
#: Suffixes of neighbouring buckets that are sorted at once, layers of them before a block is halved, places of a lane of common prefixes.
BLOCK, LAYERS, LANE = 1 << 13, 40, 64
#: Words that a run may take beyond its first, on an average, before buckets are filled one after the other.
ROUNDS = 4
_LAST, _FULL = np.iinfo(np.int64).max, _U(2**64 - 1)


# ---- suffix arrays -------------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one.  The last symbol is the smallest and stands nowhere else."""
    differs = np.flatnonzero(t[:-1] != t[1:])
    return np.append(np.repeat(t[differs] < t[differs + 1], np.diff(differs, prepend=-1)), True)


class Runs:
    """Places of one kind with their runs, which go on to the next place of the other kind; from the order of these, the seeds, follows theirs.

    Suffixes are in the order of their runs' symbols and then of the seeds' ranks, and a place of the kind comes before a seed of its symbol. As many symbols as a word holds are sorted together with the rank; where
    runs are longer, equal ones go on with the next word. Where that takes long, as for long runs of one symbol, buckets are filled one after the other.
    """

    def __init__(self, t: np.ndarray, k: int, kind: np.ndarray):
        self.t, self.k, self.kind = t, k, kind
        self.run = np.minimum.accumulate(np.where(kind, np.int32(len(t)), np.arange(len(t), dtype=np.int32))[::-1])[::-1] - np.arange(len(t), dtype=np.int32)
        bits, ends = (2 * k - 1).bit_length(), int(np.count_nonzero(kind[:-1] & ~kind[1:]))
        self.low = max(ends - 1, 0).bit_length()
        self.width = min((64 - self.low) // bits, int(self.run.max()) + 1)
        code = ((t.astype(_U) << _U(1)) | ~kind) << _U(self.low)
        on = _U(0) - kind.astype(_U)
        self.word = code
        for j in range(1, self.width):
            rest = self.word[1:] & on[:-1]  # nothing behind a seed
            self.word = code << _U(bits * j)
            self.word[:-1] |= rest
        #: The bit of a word that is set if its j-th place is a seed.
        self.seed = [_U(1 << (self.low + bits * (self.width - 1 - j))) for j in range(self.width)]

    def induced(self, seeds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The wanted places of the kind in order, from seeds whose order within buckets is known."""
        run, width = self.run, self.width
        x = np.flatnonzero(wanted & self.kind).astype(np.int32)
        if not len(x):
            return x
        seeds = seeds[self.kind[seeds - 1]]  # those that end a run; the last place is never of the kind
        seeds = seeds[np.argsort(self.t[seeds], kind="stable")]
        if int((run[x] // width).sum()) > ROUNDS * len(x):
            out = _by_buckets(self.t, self.k, self.kind, seeds)
            return out[wanted[out]]
        rank = np.zeros(len(self.t), np.int32)
        rank[seeds] = np.arange(len(seeds), dtype=np.int32)

        def words(x):
            n = run[x]
            near = n < width
            return self.word[x] | (rank[x + n] * near).astype(_U), near

        key, near = words(x)
        done = np.sort(key)
        found = done & sum(self.seed)
        back = np.zeros(len(x), np.int32)
        for bit in self.seed:
            back += found < bit
        out = seeds[(done & _U((1 << self.low) - 1)).astype(np.int64)] - back
        if not near.all():
            order = np.argsort(key[~near])
            places, group = x[~near][order], key[~near][order]
            at, step = np.arange(len(places)), width
            while True:
                same = group[1:] == group[:-1]
                tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
                if not tied.any():
                    break
                at, group = at[tied], group[tied]
                place = places[at]
                more, near = words(place + step)
                order = np.lexsort((more, group))
                places[at], more, near = place[order], more[order], near[order]
                new = np.concatenate([[True], (group[1:] != group[:-1]) | (more[1:] != more[:-1])]).cumsum()
                at, group, step = at[~near], new[~near], step + width
            out[found == 0] = places
        return out


def _by_buckets(t: np.ndarray, k: int, kind: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All places of one kind in their suffixes' order, bucket by bucket, each following from the place after it; in a bucket ``seeds``, in their order, stand behind them.

    Small neighbouring buckets are one block: its places are found layer by layer, then sorted by symbol and the place after. A block of many layers is halved, and a bucket of its own is filled in waves.
    """
    begin = np.concatenate([[0], np.bincount(t[kind], minlength=k).cumsum()])
    head, out = begin[:-1].copy(), np.full(begin[-1], -1, np.int32)
    wanted = np.where(kind, t, np.int32(-1))  # the last place is never wanted, so that none before the first is
    behind = np.searchsorted(t[seeds], np.arange(k + 1))
    volume = begin + behind

    def waves(c):
        done = [out[begin[c] : begin[c + 1]]]
        done[0] = done[0][done[0] >= 0]
        while len(done[-1]):
            x = done[-1] - 1
            done.append(x[wanted[x] == c])
        own = np.concatenate(done)
        out[begin[c] : begin[c + 1]] = own
        return np.concatenate([own, seeds[behind[c] : behind[c + 1]]])

    def layers(a, b):
        """The block's places in order, None where they have too many layers."""
        known = out[begin[a] : begin[b]]
        known, own = known[known >= 0], seeds[behind[a] : behind[b]]
        found, source, size = [np.concatenate([known, own])], [], len(known) + len(own)
        where = np.arange(size)
        while True:
            p = found[-1] - 1
            s = wanted[p]
            on = (s >= 0) & (s < b)
            if not on.any():
                break
            if len(found) > LAYERS:
                return None
            found.append(p[on])
            source.append(where[on])
            where = size + np.arange(len(found[-1]))
            size += len(where)
        places = np.concatenate(found)
        role = np.repeat([0, 2, 1], [len(known), len(own), size - len(known) - len(own)])
        group = (t[places].astype(np.int64) * 3 + role) * size
        key, fresh = np.arange(size), len(known) + len(own)
        for _ in found:  # each round settles one more layer
            order = np.argsort(group + key, kind="stable")
            if len(source):
                place = np.empty(size, np.int64)
                place[order] = np.arange(size)
                key[fresh:] = place[np.concatenate(source)]
        places, role = places[order], role[order]
        out[begin[a] : begin[b]] = places[role != 2]
        return places

    edges, a = [], 0
    while a < k:
        b = max(a + 1, int(np.searchsorted(volume, volume[a] + BLOCK, side="right")) - 1)
        edges.append((a, b))
        a = b
    edges.reverse()
    while edges:
        a, b = edges.pop()
        ordered = waves(a) if b - a == 1 else layers(a, b)
        if ordered is None:
            edges += [((a + b) // 2, b), (a, (a + b) // 2)]
            continue
        x = ordered - 1
        x = x[wanted[x] >= b]
        if len(x):
            s = t[x]
            order = np.argsort(s, kind="stable")
            x, s = x[order], s[order]
            cut = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            many = np.diff(np.append(cut, len(s)))
            out[head[s] + np.arange(len(s)) - np.repeat(cut, many)] = x
            head[s[cut]] += many
    return out


def _induce(larger_runs: Runs, smaller_runs: Runs, lms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes in order from the given order of leftmost-smaller ones: the larger ones from these, then the smaller ones from the larger ones, from the last symbol to the first."""
    t, k, last = larger_runs.t, larger_runs.k, len(wanted) - 1
    head = np.zeros(len(t), bool)  # larger ones that smaller ones follow from
    head[1:] = smaller_runs.kind[:-1]
    larger = larger_runs.induced(lms, wanted | head)
    smaller = smaller_runs.induced(larger[::-1], wanted)[::-1]
    larger = larger[wanted[larger]]
    if wanted[last]:
        smaller = np.concatenate([np.array([last], np.int32), smaller])
    # In a bucket the larger ones stand first.
    a, b = (np.bincount(t[x], minlength=k) for x in (larger, smaller))
    out = np.empty(len(larger) + len(smaller), np.int32)
    out[np.arange(len(larger)) + np.repeat(b.cumsum() - b, a)] = larger
    out[np.arange(len(smaller)) + np.repeat(a.cumsum(), b)] = smaller
    return out


def suffix_array(symbols: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes (or of the wanted ones) in order, for symbols from 0 on, none far above the others' number.  Names of the leftmost-smaller substrings are a string of their own, sorted in the same way unless all differ."""
    if not len(symbols):
        return np.zeros(0, np.int64)
    t = np.append(symbols.astype(np.int64) + 1, 0)
    t = (np.bincount(t) > 0).cumsum()[t] - 1
    k = int(t.max()) + 1
    t = t.astype(np.uint16 if k < 1 << 16 else np.int32)
    wanted = np.append(np.ones(len(symbols), bool) if wanted is None else wanted, False)
    small = _types(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    inner = small.copy()
    inner[-1] = False
    kinds = Runs(t, k, ~small), Runs(k - 1 - t, k, inner)
    if len(lms) > 1:
        ordered = _induce(*kinds, lms, is_lms)
        place = np.zeros(len(t), np.int64)
        place[lms] = np.arange(len(lms))
        length = np.append(np.diff(lms) + 1, 1)  # a substring ends with the first symbol of the next one
        i = place[ordered]
        new = np.concatenate([[0], _differ(t, ordered, length[i])]).cumsum()
        names = np.zeros(len(lms), np.int64)
        names[i] = new
        lms = ordered if new[-1] == len(lms) - 1 else lms[suffix_array(names)]
    return _induce(*kinds, lms, wanted)


def _differ(t: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each substring differs from the one before, symbol by symbol."""
    out = length[1:] != length[:-1]
    same = np.flatnonzero(~out)
    n = length[1:][same]
    ends = np.cumsum(n)
    for a in range(0, len(same), 1 << 15):
        b = min(a + (1 << 15), len(same))
        base = ends[a] - n[a]
        step = np.arange(ends[b - 1] - base) - np.repeat(ends[a:b] - n[a:b] - base, n[a:b])
        x = np.repeat(starts[1:][same[a:b]], n[a:b]) + step
        y = np.repeat(starts[:-1][same[a:b]], n[a:b]) + step
        out[same[a:b]] = np.logical_or.reduceat(t[x] != t[y], ends[a:b] - n[a:b] - base)
    return out


def permuted_prefixes(flat: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the suffixes of an array with the ones before, up to ``most`` bytes each; 0 for the first.

    They are computed in the order of the text's places: a place shares all but one byte of what the place before it shares, so comparing goes on from there. Lanes of ``LANE`` places advance side by side,
    only their first places are compared afresh, and those where the place before (or its neighbour's next one) isn't in the array.
    """
    present = np.zeros(len(flat) + 1, bool)
    present[sa[:1]] = True
    rank = np.zeros(len(flat), np.int64)
    rank[sa] = np.arange(len(sa))
    others = np.zeros(len(flat), bool)
    others[sa[1:]] = True
    order = rank[np.flatnonzero(others)] - 1
    present[:-1] |= others
    x, y = sa[1:][order], sa[:-1][order]
    follows = np.zeros(len(x), bool)
    follows[1:] = (x[1:] == x[:-1] + 1) & present[y[:-1] + 1]
    room = np.minimum(most, len(flat) - np.maximum(x, y))
    padded = np.concatenate([flat, np.zeros(most + 16, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (len(flat) + most + 8, 8), (1, 1))
    got = np.zeros(len(x), np.int64)
    for step in range(LANE):
        r = np.arange(step, len(x), LANE)
        at = np.where(follows[r], np.maximum(got[r - 1] - 1, 0), 0) if step else np.zeros(len(r), np.int64)
        live = np.flatnonzero(at < room[r])
        while len(live):
            i, n = r[live], at[live]
            differs = word[x[i] + n].view(_U).ravel() ^ word[y[i] + n].view(_U).ravel()
            below = (differs & (~differs + _U(1))) - _U(1)  # the bits below the lowest that differs, which is in the first differing byte; all where none does
            n = n + (np.bitwise_count(below) >> 3)
            at[live] = n
            live = live[(differs == 0) & (n < room[i])]
        got[r] = np.minimum(at, room[r])
    out = np.zeros(len(sa), np.int64)
    out[1:][order] = got
    return out


# ---- anchors -------------------------------------------------------------------------------------------------------------


def _least_places(h: np.ndarray, window: int) -> np.ndarray:
    """Where in each window the hash is smallest, by its upper 48 bits, the leftmost of equal ones; 2**15 windows at once, with places in the lower bits."""
    out = np.empty(len(h) - window + 1, np.int32)
    for a in range(0, len(out), 1 << 15):
        v = h[a : a + (1 << 15) + window - 1] >> _U(16) << _U(16)
        v |= np.arange(len(v), dtype=_U)
        have = 1
        while have < window:
            step = min(have, window - have)
            v = np.minimum(v[:-step], v[step:])
            have += step
        out[a : a + (1 << 15)] = (v & _U(65535)).astype(np.int32) + np.int32(a)
    return out


def anchors(flat: np.ndarray, off: np.ndarray, least: int, k: int) -> tuple[np.ndarray, ...]:
    """(row, place, hash, first, last) of the anchors of texts: first and last are the places of the first and the last string of ``least`` bytes whose anchor it is.

    Anchors have the smallest of many hashes, whose upper bits would give the first shards most of them, so the hashes that are returned are scrambled once more.
    """
    out = [[], [], [], [], []]
    for a, b in tb.slices(off, 1 << 16):
        o = off[a : b + 1] - off[a]
        part = flat[off[a] : off[b]]
        if len(part) < least:
            continue
        h = tb.kgram_hash(part, k)
        at = _least_places(h, least - k + 1)
        # Strings begin up to ``least`` before a text's end; what lies between is left out below.
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        edges = np.concatenate([o[:-1], (o[1:] - least + 1)[np.diff(o) >= least]])
        new[edges[edges < len(at)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        row = np.searchsorted(o, first, side="right") - 1
        on = first + least <= o[row + 1]
        first, last, row, at = first[on], last[on], row[on], at[first[on]].astype(np.int64)
        for c, x in zip(out, (row + a, at - o[row], tb.mix(h[at]), first - o[row], last - o[row]), strict=True):
            c.append(x)
    kinds = (np.int64, np.int64, _U, np.int64, np.int64)
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards)) >> _U(32)


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """All places first, first + 1, ... of each range."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


class Piece:
    """Surroundings of a chunk: text from ``at`` on, of ``size`` bytes, of the document ``row``; equal ones are found by hash and confirmed byte by byte."""

    def __init__(self, flat, off, row, begin, size, h, most):
        self.flat, self.row, self.begin, self.size, self.h, self.at = flat, row, begin, size, h, off[row] + begin
        mark = np.zeros(len(row), _U)
        power = tb._powers(most)[:most]
        for a in range(0, len(row), 1 << 13):
            grid, inside = self._grid(slice(a, a + (1 << 13)), most)
            mark[a : a + (1 << 13)] = ((grid.astype(_U) + _U(1)) * power * inside).sum(axis=1)
        self.mark, self.most = tb.mix(mark ^ tb.mix(size.astype(_U))), most

    def _grid(self, which, most):
        at, size = self.at[which], self.size[which]
        place = np.arange(most)
        return self.flat[np.minimum(at[:, None] + place, len(self.flat) - 1)], place < size[:, None]

    def groups(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order in which equal surroundings stand together, the smallest id first, and where in it each one's first stands."""
        order = np.lexsort((self.begin, self.row, ids[self.row], self.mark))
        n = len(order)
        first = np.ones(n, bool)
        if n > 1:
            first[1:] = self.mark[order][1:] != self.mark[order][:-1]
            same = np.flatnonzero(~first)
            for a in range(0, len(same), 1 << 13):
                i = same[a : a + (1 << 13)]
                (x, on), (y, _) = self._grid(order[i], self.most), self._grid(order[i - 1], self.most)
                first[i] = (self.size[order[i]] != self.size[order[i - 1]]) | ((x != y) & on).any(axis=1)
        return order, np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else order


def covered(text: bytes, starts: np.ndarray, least: int) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs (start, length) that strings of ``least`` bytes at ``starts`` (sorted, each once) cover, and the bytes that are left."""
    if not len(starts):
        return [], text
    cut = np.flatnonzero(starts[1:] > starts[:-1] + least) + 1
    a, b = starts[np.concatenate([[0], cut])].tolist(), (starts[np.append(cut, len(starts)) - 1] + least).tolist()
    return [(x, y - x) for x, y in zip(a, b, strict=True)], b"".join(text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True))


def repeats(texts: list[bytes], ids: np.ndarray, least: int) -> np.ndarray:
    """For each surrounding the smallest id that has the string of ``least`` bytes at each of its places, (surroundings, places); of equal surroundings each has all ids'."""
    kind: dict[bytes, int] = {}
    which = np.fromiter((kind.setdefault(t, len(kind)) for t in texts), np.int64, len(texts))
    flat, off = tb.flatten(list(kind))
    size = np.diff(off)
    owner = np.repeat(np.arange(len(kind)), size)
    own_id = np.full(len(kind), _LAST)
    np.minimum.at(own_id, which, ids)
    # a separator after each surrounding, smaller than any byte
    symbols = np.insert(flat.astype(np.int32) + 1, off[1:], 0)
    place = np.arange(len(flat))
    begins = place[place + least <= off[1:][owner]]
    wanted = np.zeros(len(symbols), bool)
    wanted[begins + owner[begins]] = True
    back = np.zeros(len(symbols), np.int64)
    back[place + owner] = place
    sa = back[suffix_array(symbols, wanted)]
    smallest = np.full((len(kind), max(1, int(size.max(initial=0)) - least + 1)), _LAST)
    if len(sa):
        cut = np.flatnonzero(permuted_prefixes(flat, sa, least) < least)
        low = np.minimum.reduceat(own_id[owner[sa]], cut)
        smallest[owner[sa], sa - off[owner[sa]]] = low[np.searchsorted(cut, np.arange(len(sa)), side="right") - 1]
    return smallest[which]


def _join(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column] or [np.zeros(0, kind)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, anchor: int | None = None, chunk_bytes: int = CHUNK, hot: int = HOT) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, spans (array of start, length), kept (the bytes that are left), kept_sha256.

    Texts are their UTF-8 bytes, null is empty. A byte goes if a string of ``least`` bytes that covers it starts in a document of a smaller id as well; strings are judged on the input and never
    cross documents. Rows that repeat an id are one document to each other: they take nothing from each other. A null id is larger than any other (and one document with the largest long, if a row has that). ``anchor``
    (by default about half of ``least``, and 24 less at most), ``chunk_bytes`` and ``hot`` only change how the work is dealt; a string may hold 64 anchors at most. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    anchor = max((least + 1) // 2, least - 24) if anchor is None else anchor
    if not 0 < anchor < least or least - anchor + 1 > 64:
        raise ValueError("0 < anchor < least, and least - anchor < 64")
    rows, chunks = common.chunked(docs, id_col, text_col, chunk_bytes)
    shards = max(1, -(-chunks * chunk_bytes // SHARD))
    # A null id would turn all ids of its batch into floats.
    rows = rows.withColumn("none", F.col("id").isNull()).withColumn("id", F.coalesce("id", F.lit(int(_LAST))))
    most = 2 * least - anchor  # bytes of a surrounding at most
    narrow = ["chunk", "rows", "starts", "sizes", "bytes", "masks"]

    def read(pdf):
        """Rows in an order that repeated ones don't change."""
        pdf = pdf.sort_values(["id", "text"], kind="stable", ignore_index=True)
        return pdf, pdf["id"].to_numpy(np.int64), *tb.flatten(pdf["text"])

    def send(pdf):
        _, ids, flat, off = read(pdf)
        row, _, h, _, _ = anchors(flat, off, least, anchor)
        order = np.lexsort((ids[row], h))
        h, d = h[order], ids[row][order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        cut = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= d[1:] != d[:-1]
        kinds, many = h[cut], np.minimum(np.add.reduceat(fresh, cut, dtype=np.int64), 65535).astype(np.uint16) if len(cut) else np.zeros(0, np.uint16)
        edges = np.searchsorted(_shard(kinds, shards), np.arange(shards + 1))
        out = [(int(pdf["chunk"].iloc[0]), s, kinds[a:b].tobytes(), many[a:b].tobytes()) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
        return pd.DataFrame(out, columns=["chunk", "shard", "keys", "many"])

    def meet(pdf):
        """For each anchor of each chunk: 0 if one document has it, 1 if several do, 2 if very many do."""
        keys = [np.frombuffer(x, _U) for x in pdf["keys"]]
        kinds, which = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(which, weights=_join(pdf["many"], np.uint16), minlength=len(kinds))
        kind = ((n > 1).astype(np.uint8) + (n > hot))[which]
        ends = np.cumsum([len(x) for x in keys])
        return pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "kinds": [kind[e - len(x) : e].tobytes() for x, e in zip(keys, ends, strict=True)]})

    columns = ["chunk", "shard", "ids", "rows", "starts", "sizes", "fine", "bytes", "masks"]

    def surround(left, right):
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        chunk = int(left["chunk"].iloc[0])
        _, ids, flat, off = read(left)
        row, _, h, first, last = anchors(flat, off, least, anchor)
        which = np.unique(h, return_inverse=True)[1]
        kind = _join(right.sort_values("shard")["kinds"], np.uint8)[which] if len(h) else np.zeros(0, np.uint8)
        on, single = kind == 1, kind == 2
        many = (last - first + 1)[single]
        begin = np.concatenate([first[on], _ranges(first[single], many)])
        size = np.concatenate([(last - first)[on] + least, np.full(len(begin) - int(on.sum()), least)])
        row_, h_ = np.concatenate([row[on], np.repeat(row[single], many)]), np.concatenate([h[on], np.zeros(len(begin) - int(on.sum()), _U)])
        piece = Piece(flat, off, row_, begin, size, h_, most)
        piece.h[int(on.sum()) :] = piece.mark[int(on.sum()) :]
        order, head = piece.groups(ids)
        heads = order[head] if len(order) else order
        later = ids[row_[order]] > ids[row_[heads]]
        again = ~later & (order != heads)
        binary = lambda x, t=np.int32: x.astype(t).tobytes()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        own = -1 - chunk  # a group that the shards' step passes through
        out = []
        j = order[later]  # an earlier document of the chunk has the whole surrounding
        if len(j):
            strings = (size[j] - least + 1).astype(_U)
            out.append((chunk, own, b"", binary(row_[j]), binary(begin[j]), b"", b"", b"", binary(_FULL >> (_U(64) - strings), _U)))
        j, k = order[again], heads[again]  # the same document has it again: what its first place gets counts here too
        if len(j):
            out.append((chunk, own, b"", binary(row_[j]), binary(begin[j]), binary(row_[k]), b"", binary(begin[k]), b""))
        j = order[order == heads]
        shard = _shard(piece.h[j], shards)
        j = j[np.argsort(shard, kind="stable")]
        edges = np.searchsorted(np.sort(shard), np.arange(shards + 1))
        for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                i = j[a:b]
                text = b"".join(flat[x : x + n].tobytes() for x, n in zip(piece.at[i].tolist(), size[i].tolist(), strict=True))
                out.append((chunk, s, binary(ids[row_[i]], np.int64), binary(row_[i]), binary(begin[i]), binary(size[i], np.uint16), binary(piece.h[i] & _U(255), np.uint8), squeeze(text), b""))
        return pd.DataFrame(out, columns=columns)

    def sort(pdf):
        if pdf["shard"].iloc[0] < 0:
            return pdf[narrow]
        size, ids, fine = _join(pdf["sizes"], np.uint16).astype(np.int64), _join(pdf["ids"], np.int64), _join(pdf["fine"], np.uint8)
        text = b"".join(map(zstandard.ZstdDecompressor().decompress, pdf["bytes"]))
        ends = np.cumsum(size)
        mask = np.zeros(len(size), _U)
        # Parts of the shard: surroundings of one anchor are in one.
        volume = np.cumsum(np.bincount(fine, weights=size, minlength=256))
        part = (np.maximum(volume - 1, 0) // PART).astype(np.int64)[fine]
        for p in np.unique(part).tolist():
            on = np.flatnonzero(part == p)
            least_id = repeats([text[e - n : e] for e, n in zip(ends[on].tolist(), size[on].tolist(), strict=True)], ids[on], least)
            bits = np.arange(least_id.shape[1]).astype(_U)
            mask[on] = ((least_id < ids[on][:, None]).astype(_U) << bits).sum(axis=1, dtype=_U)
        out, b = [], 0
        for c, r, s in zip(pdf["chunk"], pdf["rows"], pdf["starts"], strict=True):
            a, b = b, b + len(r) // 4
            hit = mask[a:b] > 0
            if hit.any():
                out.append((c, np.frombuffer(r, np.int32)[hit].tobytes(), np.frombuffer(s, np.int32)[hit].tobytes(), b"", b"", mask[a:b][hit].tobytes()))
        return pd.DataFrame(out, columns=narrow)

    def cut_out(left, right):
        left, _, flat, off = read(left)
        plain = right["masks"].str.len() > 0
        row, start, mask = (_join(right[c][plain], t) for c, t in (("rows", np.int32), ("starts", np.int32), ("masks", _U)))
        again = [_join(right[c][~plain], np.int32) for c in ("rows", "starts", "sizes", "bytes")]
        # What the first place of a surrounding got, for its other places in the same document.
        key, wanted = off[row] + start, off[again[2]] + again[3]
        order = np.argsort(key, kind="stable")
        if len(key) and len(wanted):
            lo, hi = (np.searchsorted(key[order], wanted, side=s) for s in ("left", "right"))
            many = hi - lo
            of = order[_ranges(lo, many)]
            row, start, mask = np.concatenate([row, np.repeat(again[0], many)]), np.concatenate([start, np.repeat(again[1], many)]), np.concatenate([mask, mask[of]])
        place, hit = off[row] + start, np.zeros(len(flat), bool)
        for k in range(least - anchor + 1):
            hit[place[(mask >> _U(k)) & _U(1) > 0] + k] = True
        at = np.flatnonzero(hit)
        edges = np.searchsorted(at, off)
        out = []
        for i in range(len(left)):
            text = flat[off[i] : off[i + 1]].tobytes()
            spans, kept = covered(text, at[edges[i] : edges[i + 1]] - off[i], least)
            out.append((len(text), len(text) - len(kept), len(spans), [{"start": a, "length": n} for a, n in spans], kept, hashlib.sha256(kept).hexdigest()))
        res = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])
        res.insert(0, "id", pd.arrays.IntegerArray(left["id"].to_numpy(np.int64), left["none"].to_numpy(bool)))
        return res

    sent = rows.groupBy("chunk").applyInPandas(send, "chunk int, shard int, keys binary, many binary")
    shared = common.stage(sent.groupBy("shard").applyInPandas(meet, "chunk int, shard int, kinds binary"), "shared")
    wide = "chunk int, shard int, ids binary, rows binary, starts binary, sizes binary, fine binary, bytes binary, masks binary"
    around = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(surround, wide)
    masks = around.groupBy("shard").applyInPandas(sort, ", ".join(f"{c} {'int' if c == 'chunk' else 'binary'}" for c in narrow))
    masks = common.stage(masks, "masks")
    common.discard(shared)
    final = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, length: long>>, kept binary, kept_sha256 string"
    return rows.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInPandas(cut_out, final).withColumnRenamed("id", id_col)
