import hashlib

import numpy as np
import pytest

from furrow.llm.vector_codes import entry_sums, flat_blocks, hilbert, limit_of, nearest, op13_vector_codes, quantise, shortlists

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries=64, parts=16, rounds=2):
    """(codebooks, [(vec_id, label, code, error)]) by comparing everything with everything, in Python's integers."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    if not kept:
        return None, []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    most = limit_of(width)
    kept = [(i, [np.float32(x) for x in v], y) for i, v, y in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[max(-most, min(most, int(np.floor(np.float64(x) * 256)))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for v in whole]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        best = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, b in zip(cut, best) if b[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    return books, [(i, y, bytes(e for _, e in b), sum(d for d, _ in b)) for (i, _, y), b in zip(kept, assign())]


def same(spark, rows, schema=SCHEMA, **options):
    made = quantise(spark.createDataFrame(rows, schema), **options)
    books, want = brute([r[:3] for r in rows], options.get("entries", 64), options.get("parts", 16))
    got = [(r.vec_id, r.label, bytes(r.code), r.error) for r in made.codes.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert made.codebooks.tolist() == (books if books else np.zeros((options.get("parts", 16), 0, 1)).tolist())


def some_rows(seed, n, width):
    """Clusters, a hot vector, ties, repeated ids, null ids and labels."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)).astype(np.float32)
    rows = []
    for k in range(n):
        v = centres[0] if k % 3 == 0 else centres[rng.integers(5)] + rng.normal(scale=0.1, size=width).astype(np.float32)
        rows.append((int(rng.integers(n)) if k % 11 else None, v.tolist(), int(k % 4) if k % 5 else None))
    return rows


@pytest.mark.parametrize("chunk_values,leaf", [(1 << 20, 32), (64 * 7, 4)])
def test_against_brute_force(spark, chunk_values, leaf):
    same(spark, some_rows(1, 150, 64), chunk_values=chunk_values, leaf=leaf)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(2, 40, 20) + [(1, None, 1), (2, [1.0, None], 1), (3, [nan] * 20, 1), (4, [inf, 0.0], None), (5, [], 2), (6, [1.5] * 33, 2), (7, [3e38, -3e38, 1e-40], 3), (8, [-0.0, -1 / 512], 3)]
    same(spark, rows, leaf=3)
    same(spark, [(None, [], None)] * 3)
    same(spark, [])
    same(spark, [(1, None, 1)])


def test_few_rows_and_other_sizes(spark):
    same(spark, some_rows(3, 9, 64), entries=200)
    same(spark, some_rows(4, 60, 70), entries=5, parts=1, leaf=2)
    same(spark, [(*r, "x", 1.0) for r in some_rows(5, 30, 32)], SCHEMA + ", code string, n double")


def test_shortlists_prune_and_keep_the_nearest():
    rng = np.random.default_rng(6)
    points = rng.integers(-200, 200, size=(4_001, 4))
    entries = points[:64].copy()
    entries[10] = entries[3]
    blocks = flat_blocks(points)
    listed = shortlists(blocks, entries)
    assert listed.mean() < 0.45
    want = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    places, best, distance = nearest(blocks, entries, np.arange(len(listed)), listed)
    assert sorted(places.tolist()) == list(range(len(points)))
    assert (want.argmin(axis=1)[blocks.order[places]] == best).all() and (want.min(axis=1)[blocks.order[places]] == distance).all()
    sums = entry_sums(blocks, entries)
    assert (sums[:, 0] == np.bincount(want.argmin(axis=1), minlength=64)).all() and (sums[:, 1:].sum(axis=0) == points.sum(axis=0)).all()


def test_hilbert_steps_are_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(16)] * 3, indexing="ij"), axis=-1).reshape(-1, 3) * 4369
    walk = grid[np.argsort(hilbert(grid))] // 4369
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_query_digests(spark, tmp_path):
    rows = some_rows(7, 90, 64)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_vector_codes(spark, str(tmp_path)).collect()
    books, want = brute(rows)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by_label = {}
    for _, y, _, d in want:
        by_label[y] = by_label.get(y, 0) + d
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(i, c.hex(), d, by_label[y], digest) for i, y, c, d in want], key=repr)
