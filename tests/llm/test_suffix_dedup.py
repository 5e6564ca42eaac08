import hashlib
import random

import numpy as np
import pytest

from sheafwork.llm import queries, suffix_dedup


def brute(rows, least):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            w = b[k : k + least]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    for n, k in [(1, 1), (2, 1), (50, 1), (300, 2), (500, 4), (2000, 200), (997, 65000)]:
        x = rng.integers(0, k, n)
        for s in (x, np.tile(x[: n // 7 + 1], 7), np.sort(x), np.sort(x)[::-1]):
            want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert suffix_dedup.suffix_array(s).tolist() == want


def test_random_documents(spark):
    rng = random.Random(3)
    alphabet = "ab é"
    parts = ["".join(rng.choices(alphabet, k=rng.randint(3, 40))) for _ in range(30)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 12)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "a" * 500), (303, "a" * 700), (304, "x" * 20 + "\0" * 60), (305, "\0" * 61), (306, rows[0][1]), (307, rows[0][1]), (308, "z" * 50), (309, "z" * 50)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, chunk int")
    for least, anchor in ((20, 7), (50, 26)):
        assert got(suffix_dedup.remove_repeats(df, least=least, anchor=anchor, chunk_bytes=3000)) == brute(rows, least)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 30 + "w" * 40), (1, "q" * 30 + "w" * 40), (2, "w" * 55)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.remove_repeats(df, least=20, anchor=8)) == brute(rows, 20)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op3_suffix_dedup(spark, sf)) == brute(rows, 50)


def test_null_and_large_ids(spark):
    text, big = "q" * 30 + "w" * 40, 2**60
    rows = [(None, text), (big + 3, text), (big + 1, text), (None, text + "e" * 30), (None, "r" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    last = 2**63 - 1
    want = brute([(last if i is None else i, t) for i, t in rows], 20)
    for chunk_bytes in (60, 1 << 20):
        out = [(last if r[0] is None else r[0], *r[1:]) for r in [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, least=20, anchor=8, chunk_bytes=chunk_bytes).collect()]]
        assert sorted(out) == want


def test_hot_anchors_runs_and_long_strings(spark):
    """Anchors that many documents have, dealt by string; runs of one byte and short periods; strings of other lengths; extra columns with names of the work's own."""
    rng = random.Random(8)
    phrase = "a phrase that everybody uses in some context, "
    rows = [(i, "".join(rng.choices("xyz ", k=30)) + phrase[: rng.randint(28, 46)] + "".join(rng.choices("uvw ", k=30))) for i in range(80)]
    rows += [(100, "ab" * 300), (101, "ab" * 200 + "c"), (102, "q" * 900), (102, "q" * 300), (103, "q" * 500 + "r"), (104, phrase * 20), (105, phrase * 9)]
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, shard int, masks string, rows int")
    for least, hot in ((30, 1), (30, 2048), (120, 3), (50, 5)):
        assert got(suffix_dedup.remove_repeats(df, least=least, chunk_bytes=2000, hot=hot)) == brute(rows, least)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, least=120, anchor=26)


def test_common_prefixes_and_recursion():
    rng = np.random.default_rng(4)
    flat = rng.integers(0, 3, 4000).astype(np.uint8)
    sa = suffix_dedup.suffix_array(flat.astype(np.int64))
    text = flat.tobytes()
    assert [text[a:] for a in sa] == sorted(text[i:] for i in range(len(text)))
    want = [0]
    for a, b in zip(sa[1:], sa[:-1]):
        n = 0
        while n < 20 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        want.append(n)
    assert suffix_dedup.permuted_prefixes(flat, sa, 20).tolist() == want


def test_recursion_for_every_alphabet(monkeypatch):
    """Reduced strings of thousands of names are sorted by the same function, whatever blocks and layers there are."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 40, 9) for _ in range(400)]
    s = np.concatenate([words[i] for i in rng.integers(0, 400, 3000)])
    want = np.array(sorted(range(len(s)), key=lambda i: s[i : i + 400].tolist()))
    own, names = suffix_dedup.suffix_array, []

    def watched(symbols):
        names.append(len(np.unique(symbols)))
        return own(symbols)

    monkeypatch.setattr(suffix_dedup, "suffix_array", watched)
    for block, layers in ((1, 1), (64, 1), (1 << 14, 40), (1 << 30, 1 << 30)):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        monkeypatch.setattr(suffix_dedup, "LAYERS", layers)
        names.clear()
        got_ = watched(s)
        assert (got_ == want).all() and len(names) > 1 and max(names[1:]) > 512


def test_common_prefixes_of_a_part_of_the_places():
    """Where some places are not in the array, the place before says nothing and the prefix is compared afresh."""
    rng = np.random.default_rng(9)
    text = b"".join([b"abcabcab", b"bcabca"][i] for i in rng.integers(0, 2, 400))
    flat = np.frombuffer(text, np.uint8)
    sa = suffix_dedup.suffix_array(flat.astype(np.int64))
    sa = sa[rng.random(len(sa)) < 0.7]
    want = [0]
    for a, b in zip(sa[1:], sa[:-1]):
        want.append(next((n for n in range(30) if max(a, b) + n >= len(text) or text[a + n] != text[b + n]), 30))
    assert suffix_dedup.permuted_prefixes(flat, sa, 30).tolist() == want


def test_anchors_are_dealt_evenly():
    """An anchor has the smallest hash of many; shards by that hash itself would be more and more empty."""
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 256, 200_000).astype(np.uint8)
    h = suffix_dedup.anchors(flat, np.array([0, len(flat)]), 50, 26)[2]
    many = np.bincount(suffix_dedup._shard(h, 8).astype(np.int64), minlength=8)
    assert many.min() > 0.8 * many.max()


def test_anchors_of_texts_beyond_a_block():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in (0, 19, 20, 90_000, 3, 400)]
    flat, off = suffix_dedup.tb.flatten(texts)
    got_, want = list(zip(*[x.tolist() for x in suffix_dedup.anchors(flat, off, 20, 7)])), []
    for row, text in enumerate(texts):
        full = suffix_dedup.tb.kgram_hash(np.frombuffer(text, np.uint8), 7)
        upper = (full >> np.uint64(16)).tolist()
        for i in range(len(text) - 19):
            at = min(range(i, i + 14), key=lambda p: (upper[p], p))
            if i and want[-1][1] == at:
                want[-1][4] = i
            else:
                want.append([row, at, int(suffix_dedup.tb.mix(full[at : at + 1])[0]), i, i])
    assert got_ == [tuple(w) for w in want]


def test_many_shards(spark, monkeypatch):
    """Kinds of anchors come back from all shards in the order in which a chunk has them."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000)
    rng = random.Random(5)
    parts = ["".join(rng.choices("abcdefgh ", k=rng.randint(20, 120))) for _ in range(60)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 6)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2048, 4):
        assert got(suffix_dedup.remove_repeats(df, chunk_bytes=4000, hot=hot)) == brute(rows, 50)


def test_wanted_suffixes_by_words_and_by_buckets(monkeypatch):
    """Wanted suffixes only, runs of all lengths, whether equal runs go on word by word or buckets are filled in turn."""
    rng = np.random.default_rng(7)
    for rounds in (-1, 0, suffix_dedup.ROUNDS, 10**9):
        monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
        for n, k in [(1, 1), (40, 2), (300, 3), (700, 256), (500, 60000)]:
            x = rng.integers(0, k, n)
            for s in (x, np.sort(x), np.sort(x)[::-1], np.repeat(x, rng.integers(1, 30, n))[:900], np.tile(x[: n // 9 + 1], 9)):
                order = sorted(range(len(s)), key=lambda i: s[i:].tolist())
                wanted = rng.random(len(s)) < 0.3
                assert suffix_dedup.suffix_array(s).tolist() == order
                assert suffix_dedup.suffix_array(s, wanted).tolist() == [i for i in order if wanted[i]]
