import random
import re

import numpy as np
import pytest

import corpus_pipeline
from furrow.llm import near_copies
from furrow.llm.frames import table
from furrow.llm.near_copies import near_copy_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(a & b)
            if 5 * n >= 4 * len(a | b):
                parent[root(i)] = root(j)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[root(k)] = min(d, low.get(root(k), d))
    return sorted((d, low[root(k)]) for k, (d, _) in enumerate(rows))


def result(df):
    return sorted(tuple(r) for r in df.collect())


def edited(rng, text, at):
    words = text.split()
    for i in at:
        words[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(words)


#: similarity: shingles, words changed
PLANTED = {0.8: (180, 4), 0.85: (185, 3), 0.9: (190, 2), 0.95: (195, 1)}


@pytest.mark.parametrize("similarity", PLANTED)
def test_stage_drops_planted_near_copies(spark, similarity):
    rng = random.Random(similarity)
    n, changed = PLANTED[similarity]
    rows = []
    for k in range(100):
        text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(n + 4))
        copy = edited(rng, text, [20 + 40 * i for i in range(changed)])
        a, b = shingles(text), shingles(copy)
        assert len(a & b) / len(a | b) == similarity
        rows += [(2 * k, text, "en", "a", 1), (2 * k + 1, copy, "en", "a", 1)]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 200, 2))


def test_pairs_under_the_least_stay(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(183))  # 179 shingles: 159 of 199 are shared
    rows = [(1, text), (2, edited(rng, text, [20, 60, 100, 140]))]
    assert result(near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("list_rows", [64, 4, 1])
def test_against_brute_force(spark, sf, list_rows):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    for g in range(3):  # groups around one text: near copies of it, and chains that lead away from it
        base = last = " ".join(f"g{g}x{rng.randrange(10**9)}" for _ in range(184))
        for k in range(30):
            last = edited(rng, last, [rng.randrange(184)])
            rows += [(10_000 + 100 * g + k, edited(rng, base, rng.sample(range(184), 2))), (20_000 + 100 * g + k, last)]
    # More texts than a list may have around one text, all too far from it and some near one another: the finer indexes must find these.
    core = [f"c{rng.randrange(10**9)}" for _ in range(300)]
    for k in range(80):
        words = core[:]
        for i in rng.sample(range(300), 12):
            words[i] = f"v{k}x{rng.randrange(10**9)}"
        rows += [(40_000 + 2 * k, " ".join(words)), (40_001 + 2 * k, edited(rng, " ".join(words), [rng.randrange(300)]))]
    rows += [(30_000, None), (30_001, ""), (30_002, "One two"), (30_003, "one  two"), (30_004, "one"), (30_005, "one two three four five")]
    assert result(near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"), list_rows)) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, text, 5, "x"), (1, text, 5, "x"), (None, text + " more", 6, None), (None, None, None, None), (None, "alone " * 9, 1, "y"), (7, "long " * 100_000, 1, "z")]
    got = near_copy_groups(spark.createDataFrame(rows, "doc_id int, text string, node int, bands string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, 1), (1, 1), (None, 1), (None, None), (None, None), (7, 7)], key=repr)
    assert near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_are_majorities_of_votes():
    rng = np.random.default_rng(4)
    first = np.array([0, 0, 1, 5, 300, 300, 1000])
    values = rng.integers(0, 2**64, first[-1], dtype=np.uint64)
    prints = near_copies.prints_of(values, first)
    assert prints.shape == (6, near_copies.POSITIONS // 8) and not prints[[0, 4]].any()
    for t in range(6):
        own = values[first[t]:first[t + 1]]
        for k in range(prints.shape[1]):
            votes = np.concatenate([near_copies._vote(own, 2 * k), near_copies._vote(own, 2 * k + 1)])
            ones = [sum((int(v) >> bit) & 1 for v in votes) for bit in range(64)]
            assert prints[t].view(np.uint64)[k] == sum((n > len(own)) << bit for bit, n in enumerate(ones))


@pytest.mark.parametrize("shared, more", [(4, (0, 1)), (12, (1, 2)), (100, (12, 13)), (400, (50, 50))])
def test_fingerprints_at_the_least_meet_in_each_index(shared, more):
    """Pairs at Jaccard 0.8 agree in many positions, share a key of each index and pass the sketch; others do none of it."""
    rng = np.random.default_rng(shared)
    pairs, tallies, strangers = 150, [], []
    for _ in range(pairs):
        core, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (shared, *more))
        other = rng.integers(0, 2**64, shared, dtype=np.uint64)
        sets = [np.concatenate([core, a]), np.concatenate([core, b]), other]
        longs = near_copies.prints_of(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
        same = longs.view(np.uint8)[0] == longs.view(np.uint8)[1]
        assert all(same[near_copies._position_sets(level)].all(axis=1).any() for level in range(len(near_copies.LEVELS)))
        assert np.bitwise_count((longs[0] ^ longs[1])[:near_copies.SKETCH].view(np.uint64)).sum() <= near_copies.SKETCH_BITS
        tallies.append(same.sum())
        strangers.append((longs.view(np.uint8)[0] == longs.view(np.uint8)[2]).sum())
    assert min(tallies) >= near_copies.TALLY > max(strangers) and np.mean(tallies) > 66 > 4 > np.mean(strangers)


def test_position_sets_are_dealt_evenly():
    for level, (size, sets) in enumerate(near_copies.LEVELS):
        places = near_copies._position_sets(level)
        assert places.shape == (sets, size) and len({tuple(sorted(p)) for p in places.tolist()}) == sets
        assert np.bincount(places.ravel(), minlength=near_copies.POSITIONS).max() <= -(-sets * size // (near_copies.POSITIONS // size * size))


def test_links_come_from_the_byte_index_and_the_tally(spark, monkeypatch):
    """Without a set of positions on which two texts agree, or with a tally that none reaches, there is no link."""
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(10**9)}" for _ in range(194))
    docs = spark.createDataFrame([(1, text), (2, edited(rng, text, [60, 120]))], "doc_id long, text string")
    assert result(near_copy_groups(docs)) == [(1, 1), (2, 1)]
    with monkeypatch.context() as m:
        m.setattr(near_copies, "TALLY", near_copies.POSITIONS + 1)
        assert result(near_copy_groups(docs)) == [(1, 1), (2, 2)]
    with monkeypatch.context() as m:
        m.setattr(near_copies, "LEVELS", ((7, 1), (7, 1)))
        assert result(near_copy_groups(docs)) == [(1, 1), (2, 2)]


def test_the_index_in_many_parts_gives_the_same(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(300)
    whole = result(near_copy_groups(docs))
    monkeypatch.setattr(near_copies, "PART_ROWS", 1)
    assert len(near_copies._parts(0, 300, 300)) == 4 and len(near_copies._parts(1, 100, 300)) == 8
    assert result(near_copy_groups(docs)) == whole


def test_parity_bits_never_exceed_the_differing_shingles():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    for size in (1, 2, 50, 400, 5000):
        a, b = (np.unique(rng.choice(pool[:size + size // 8 + 1], size, replace=False)) for _ in "ab")
        marks = near_copies._marks(np.concatenate([a, b]), np.array([0, 0, len(a), len(a) + len(b)]))
        assert marks.shape == (3, near_copies.MARK_WORDS) and not marks[0].any()
        differ = int(np.bitwise_count((marks[1] ^ marks[2]).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0
        assert not (near_copies._marks(a, np.array([0, len(a)])) ^ near_copies._marks(a[::-1], np.array([0, len(a)]))).any()


def test_a_family_under_the_least_makes_no_pairs_by_the_square(spark, monkeypatch):
    """Texts of one family that have all their shingles from others of it, though any two are at 0.67 at most."""
    rng = random.Random(9)
    spans = [[" ".join(f"s{i}o{option}w{k}" for k in range(24)) for option in range(2)] for i in range(12)]
    chosen = sorted([(i, j) for i in range(12) for j in range(i)] + [tuple(rng.sample(range(12), 4)) for _ in range(130)])
    texts = sorted({" ".join(span[i in c] for i, span in enumerate(spans)) for c in chosen})
    rows = list(enumerate(texts))
    made = []

    def counted(pairs, sets, true=near_copies._true):
        made.append(pairs.count())
        return true(pairs, sets)
    monkeypatch.setattr(near_copies, "_true", counted)
    assert result(near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == [(k, k) for k, _ in rows]
    assert len(rows) > 2 * near_copies.LIST_ROWS and sum(made) < 10 * len(rows), (len(rows), made)
