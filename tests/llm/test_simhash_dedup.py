import random
import re

import pytest
import xxhash

from furrow.llm.frames import table
from furrow.llm.simhash_dedup import links, op2_simhash_dedup, simhash_groups

SCHEMA = "doc_id long, text string"


def print_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def roots_of(prints):
    """prints: distinct fingerprints. All pairs are compared."""
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p
    some = sorted(prints)
    for i, a in enumerate(some):
        for b in some[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in prints}


def brute(rows):
    prints = [(k, print_of(t)) for k, t in rows]
    root = roots_of({p for _, p in prints})
    low = {}
    for k, p in prints:
        if k is not None:
            low[root[p]] = min(k, low.get(root[p], k))
    return sorted(((k, f"{p:016x}", low.get(root[p])) for k, p in prints), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("Alpha beta GAMMA delta épsilon zeta".split()) + str(rng.randint(0, 50)) for _ in range(300)) for _ in range(8)]
    rows = []
    for k in range(90):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = "edited"
        rows.append((k, rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(200, None), (201, ""), (202, "one"), (203, "One two"), (204, "one two"), (None, rows[0][1]), (None, "alone and nowhere else"), (3, rows[3][1]), (205, "x" * 200_000), (206, "É é É é")]
    assert result(simhash_groups(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("list_rows", [64, 2])
def test_links_lose_no_pair(spark, list_rows):
    rng = random.Random(9)
    prints = set()
    for _ in range(20):
        p = rng.getrandbits(64)
        for _ in range(30):
            prints.add(p)
            p ^= 1 << rng.randrange(64)
            p ^= rng.choice([0, 1 << rng.randrange(64)])
    dense = rng.getrandbits(64)
    prints |= {dense ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {(u % (1 << 64), v % (1 << 64)) for u, v in links(spark.createDataFrame(signed, "print long"), list_rows).collect()}
    assert all((u ^ v).bit_count() <= 2 for u, v in got)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for u, v in got:
        x, y = sorted((root(u), root(v)))
        parent[y] = x
    assert {p: root(p) for p in prints} == roots_of(prints)


def test_extra_columns_and_no_rows(spark):
    clash = spark.createDataFrame([(1, "a b c d", 1, 2, "x")], "doc_id int, text string, print long, key long, u string")
    assert result(simhash_groups(clash)) == brute([(1, "a b c d")])
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark, sf):
    assert result(op2_simhash_dedup(spark, sf)) == brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
