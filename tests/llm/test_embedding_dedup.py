import math

import numpy as np

from sheafwork.llm import embedding_dedup as ed
from sheafwork.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t=0.93):
    ids = [r[0] for r in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    n = len(rows)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if g else None for (_, v, _), g in zip(rows, good)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= t:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: (links[i], low[find(i)], low[find(i)] == ids[i]) for i in range(n)}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op7_embedding_dedup(spark, sf)) == brute(rows)


def test_cells_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 37)
    rng = np.random.default_rng(2)
    c = rng.normal(size=(12, 16)) * 3
    x = (c[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16)) * 0.7).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000 + i, x[5].tolist(), 1) for i in range(50)]  # copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0, None] * 8, 1), (2004, [float("nan")] * 16, 0), (2005, x[5].tolist(), None), (2006, [float("inf")] * 16, 0), (2007, [1.0, 0.0], 1), (2008, [2.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], SCHEMA + ", cell long")
    assert got(ed.near_vectors(df)) == brute(rows)


def nested(n, tops=6, seed=5):
    """Vectors in clusters of 6 clusters each, all of one label."""
    rng = np.random.default_rng(seed)
    top = rng.normal(size=(tops, 24)) * 6
    low = top[:, None] + rng.normal(size=(tops, 6, 24)) * 2.5
    x = (low[rng.integers(0, tops, n), rng.integers(0, 6, n)] + rng.normal(size=(n, 24)) * 0.5).astype(np.float32)
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


def as_classes(spark, rows):
    return spark.createDataFrame([(str(lab), i, i * 7919, 1, [float(y) for y in v]) for i, v, lab in rows], "label string, rep long, cls long, n long, v array<double>")


def test_cells_in_several_levels(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed, "CELLS", 4)
    rows = nested(1500)
    placed = ed.placed_in_cells(as_classes(spark, rows), math.sqrt(2 - 2 * 0.93)).toPandas()
    homes = placed[placed["home"]]
    assert sorted(homes["rep"]) == list(range(1500)) and not placed.duplicated(["cell", "rep"]).any()
    assert homes["cell"].str.count("/").max() >= 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(ed.near_vectors(df)) == brute(rows)


def test_work_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 64)
    n = [ed.exploded(ed.placed_in_cells(as_classes(spark, nested(k, tops=k // 170)), math.sqrt(2 - 2 * 0.93)))[0].count() for k in (1000, 5000)]
    assert n[1] <= 8 * n[0]


def test_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 32))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, x + rng.normal(size=x.shape) * 0.15]))]
    assert got(ed.near_vectors(spark.createDataFrame(rows, SCHEMA.replace("float", "double")))) == brute(rows)


def test_empty_table(spark):
    assert ed.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_linked_pair_is_parted_by_cells():
    rng = np.random.default_rng(4)
    x = ed.unit(rng.normal(size=(300, 8)))
    y = ed.unit(x + rng.normal(size=x.shape) * 0.1)
    near = (x * y).sum(axis=1) >= 0.93
    c = ed.spherical_kmeans(x, 10)
    reach = math.sqrt(2 - 2 * 0.93)
    home, _ = ed.visits(x, c, reach)
    other, guest = ed.visits(y, c, reach)
    assert near.any() and ((home == other) | guest[np.arange(300), home])[near].all()


def test_parts_follow_what_comes_of_a_cell(spark, monkeypatch, tmp_path):
    """Vectors that are guests in most cells: no task gives out many more rows than a part may have."""
    monkeypatch.setattr(ed, "BLOCK", 40)
    monkeypatch.setattr(ed, "COPY", 0.0, raising=False)
    monkeypatch.setattr(ed, "PART_NUMBERS", 24 * 500, raising=False)
    moved, folder = ed._moved, str(tmp_path)

    def counted(reach):
        run = moved(reach)

        def and_count(pdf, trained):
            import uuid

            out = run(pdf, trained)
            open(f"{folder}/{len(out)}-{uuid.uuid4().hex}", "w").close()
            return out

        return and_count

    monkeypatch.setattr(ed, "_moved", counted)
    rows = nested(3000)
    assert got(ed.near_vectors(spark.createDataFrame(rows, SCHEMA), threshold=0.8)) == brute(rows, 0.8)
    sizes = [int(f.name.split("-")[0]) for f in tmp_path.iterdir()]
    assert sum(sizes) > 6000 and max(sizes) < 1500
