"""Embedding near-dedup and hard negatives against plain versions."""

import itertools

import numpy as np
import pytest
from reporank.llm import hard_negatives as mining
from reporank.llm import lattice
from reporank.llm import vector_links as near

VECTOR = "vec_id long, embedding array<{kind}>, label int, id string, v int, n string, row int, key string, links int"


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x", 1, "y", 2, "z", 3) for i, v, label in rows], VECTOR.format(kind=kind))


def around(rng, centre, cosine):
    """A vector at the given cosine from a centre of length one."""
    other = rng.normal(size=len(centre))
    other -= (other @ centre) * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def unit(rng, dims=64):
    x = rng.normal(size=dims)
    return x / np.linalg.norm(x)


# lattice


def test_lattice_points():
    rng = np.random.default_rng(1)
    moves = lattice.shortest()
    assert moves.shape == (240, 8) and len(np.unique(moves, axis=0)) == 240
    assert np.allclose((moves**2).sum(axis=1), 2)
    points = rng.normal(size=(2000, 8)) * 3
    own = lattice.nearest(points)
    whole = (own == np.rint(own)).all(axis=1)
    assert (whole | (own - 0.5 == np.rint(own - 0.5)).all(axis=1)).all()
    assert (np.where(whole, own.sum(axis=1), (own - 0.5).sum(axis=1)) % 2 == 0).all()
    best = ((points - own) ** 2).sum(axis=1)
    assert (best <= 1 + 1e-9).all()  # the covering radius is 1
    for move in moves:
        assert (best <= ((points - own - move) ** 2).sum(axis=1) + 1e-9).all()


def test_probed_cells_are_the_closest():
    rng = np.random.default_rng(2)
    moves, points = lattice.shortest(), rng.normal(size=(50, 16))
    seed = rng.integers(0, 1 << 62, 17, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes = lattice.cells(points, 3, seed, moves)
    for x, own in zip(points, codes):
        home = np.concatenate([lattice.nearest(x[None, :8])[0], lattice.nearest(x[None, 8:])[0]])
        others = []
        for block, move in itertools.product((0, 8), moves):
            cell = home.copy()
            cell[block : block + 8] += move
            # a point at the cell's lattice point hashes to the cell
            others.append((((x - cell) ** 2).sum(), lattice.cells(cell[None], 0, seed, moves)[0, 0]))
        assert lattice.cells(home[None], 0, seed, moves)[0, 0] == own[0]
        assert set(own[1:]) == {c for _, c in sorted(others)[:3]}


# near-duplicates


def sound(v, label):
    return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain(rows, similarity=0.93, kind=np.float32):
    """[(vec_id, n_links, component_id)] in the order of the rows"""
    good = [i for i, (_, v, label) in enumerate(rows) if sound(v, label)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(good, 2):
        (_, x, lx), (_, y, ly) = rows[a], rows[b]
        if lx == ly and len(x) == len(y):
            x, y = (np.array(z, dtype=kind).astype(np.float64) for z in (x, y))
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= similarity:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for i, (vec, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((vec, links[i], min(ids, default=None)))
    return out


def clustered(seed=3):
    rng = np.random.default_rng(seed)
    rows, next_id = [], itertools.count()
    for label in range(3):
        for _ in range(12):
            centre = unit(rng)
            rows += [(next(next_id), around(rng, centre, 0.985).tolist(), label) for _ in range(5)]
        rows += [(next(next_id), unit(rng).tolist(), label) for _ in range(20)]
    centre, copied = unit(rng), unit(rng).tolist()
    rows += [(next(next_id), copied, 1) for _ in range(30)] + [(next(next_id), copied, 2), (next(next_id), [4 * x for x in copied], 1)]
    rows += [(next(next_id), around(rng, centre, 0.99).tolist(), 0) for _ in range(60)]
    bad = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63]
    rows += [(next(next_id), v, 1) for v in bad] + [(next(next_id), copied, None), (next(next_id), copied[:32], 1)]
    rows += [(None, copied, 1), (None, None, None), (4, copied, 1), (4, unit(rng).tolist(), 0), (None, unit(rng).tolist(), 2)]
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("held", [near.HELD, 7])
def test_links_and_components(spark, held):
    """Many tables, so that no pair is missed: then every count is that of brute force."""
    rows = clustered()
    got = near.linked_vectors(frame(spark, rows).repartition(5), tables=24, held=held)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = sorted(((*r, r[0] == r[2]) for r in plain(rows)), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_large_components_and_double(spark):
    rng = np.random.default_rng(9)
    centre = unit(rng, 16)
    rows = [(i, (1e200 * around(rng, centre, 0.995)).tolist(), 1) for i in range(20)]
    got = near.linked_vectors(frame(spark, rows, "double"), tables=24)
    assert {tuple(r) for r in got.collect()} == {(i, 19, 0, i == 0) for i in range(20)}


def test_no_vectors(spark):
    assert near.linked_vectors(frame(spark, [])).count() == 0
    lonely = near.linked_vectors(frame(spark, [(1, None, None), (2, [1.0, 0.0], 3)])).collect()
    assert sorted(tuple(r) for r in lonely) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("cosine,least", [(0.93, 0.97), (0.95, 0.99), (0.97, 0.999)])
def test_recall_of_the_tables(cosine, least):
    """Measured with the query's options on pairs exactly at a cosine."""
    rng = np.random.default_rng(4)
    x = np.array([unit(rng) for _ in range(3000)])
    y = np.array([around(rng, v, cosine) for v in x])
    tables = near.Tables(64)
    assert near.met(tables.codes(x), tables.codes(y)).any(axis=1).mean() >= least


def test_recall_against_brute_force(spark):
    """All links of a whole table, with the query's options."""
    folder = "/root/testdata/sf0.1/embeddings.parquet"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(folder).limit(300).collect()]
    rng = np.random.default_rng(6)
    rows += [
        (10_000 + 10 * i + k, around(rng, np.array(v) / np.linalg.norm(v), 0.93 + 0.02 * rng.random()).tolist(), label)
        for i, v, label in rows[:150]
        for k in range(2)
    ]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = sum(n for _, n, _ in plain(rows))
    got = sum(r.n_links for r in near.linked_vectors(frame(spark, rows)).collect())
    assert 0.97 * want <= got <= want


# hard negatives


def mined(rows, every=10, positives=5, negatives=10):
    own = []
    for vec, v, label in rows:
        if vec is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            q = [int(np.clip(np.floor(256 * float(x)), -(1 << 27), 1 << 27)) for x in v]
            own.append((vec, label, q))
    out = []
    for a, (vec, label, q) in enumerate(own):
        if vec % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), o, b, lb) for b, (o, lb, p) in enumerate(own) if b != a and len(p) == len(q)]
        for s, o, _, _ in sorted(x for x in scored if x[3] == label)[:positives]:
            ps = -s
            fits = sorted(x for x in scored if x[3] != label and 30 * ps <= -100 * x[0] <= 90 * ps)
            out += [(vec, o, r, x[1], ps, -x[0]) for r, x in enumerate(fits[:negatives], 1)]
    return out


def labelled(seed=8, n=300, dims=12):
    rng = np.random.default_rng(seed)
    centres = [unit(rng, dims) for _ in range(9)]
    rows = [(i, around(rng, centres[i % 9], 0.6 + 0.4 * rng.random()).tolist(), i % 4) for i in range(n)]
    rows += [(1000 + i, rows[5][1], i % 3) for i in range(40)]  # copies over several labels
    rows += [(20, rows[20][1], 0), (20, rows[21][1], 1), (2000, None, 1), (2010, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(2020, [], 1), (2030, [float("nan")] * dims, 1), (2040, [None] * dims, 1), (2050, [float("inf")] * dims, 2)]
    rows += [(3000, [0.0] * dims, 1), (3010, [-x for x in rows[0][1]], 0), (3020, [0.5, 0.25], 9), (3021, [0.25, 0.5], 9), (3022, [0.2, 0.3], 8)]
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("options", [{}, {"sample": 40, "fan": 4, "held": 9}, {"sample": 200, "fan": 3, "depth": 3, "held": 50}])
def test_negatives(spark, options):
    rows = labelled()
    got = mining.hard_negatives(frame(spark, rows).repartition(4), every=10, **options)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))
    assert dict(got.dtypes)["rank"] == "int"


def test_large_components_are_held(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (10.0 ** rng.integers(0, 9) * rng.normal(size=4)).tolist(), i % 2) for i in range(60)]
    got = mining.hard_negatives(frame(spark, rows, "double"), every=10)
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))


def test_nothing_to_mine(spark):
    assert mining.hard_negatives(frame(spark, [])).count() == 0
    assert mining.hard_negatives(frame(spark, [(1, [1.0], 1), (100, [1.0], 2)])).count() == 0


def test_subtrees_are_left_out():
    """Far subtrees of clustered rows go, and never one that holds a wanted row."""
    rng = np.random.default_rng(7)
    centres = np.array([unit(rng, 8) for _ in range(16)])
    rows = mining.quantised(np.array([around(rng, c, 0.98) for c in centres for _ in range(60)]).ravel()).reshape(-1, 8)
    tree = mining.Tree(rows[::3], 8, 2)
    ranges, (leaf, _) = tree.subtree_ranges(rows), tree.place(rows)
    asked = rows[:40]
    found = mining.scores(asked, rows)
    low = np.partition(found, -10, axis=1)[:, [-10]]
    high = np.full_like(low, mining.ALL)
    at, visited = tree.leaves(asked, low.astype(float), high.astype(float), ranges)
    seen = set(zip(at.tolist(), visited.tolist()))
    for r in range(40):
        assert all((r, leaf[x]) in seen for x in np.flatnonzero(found[r] >= low[r]))
    assert len(seen) < 0.5 * 40 * len(set(leaf.tolist()))
