import hashlib
import random
import zlib

import pytest

from furrow.llm import prefix_trie
from furrow.llm.prefix_trie import op12_prefix_trie, ordered, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, lent=6, family=100):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            id = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest() + f":{len(text)}"
            own.setdefault(conv, []).append((turn is not None, turn or 0, id, role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % lent
        whole[c] = own.get(c - (c % family if c >= 0 else -(-c % family)), [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, cs in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in members)]
        ends = sorted(c for c in cs if len(whole[c]) == len(path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        out.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(children), len(leaves), saved,
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def result(spark, rows, schema=SCHEMA):
    placed, sizes = ordered(spark.createDataFrame(rows, schema))
    got = trie(*rebuilt(placed, sizes)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def some_rows(seed):
    """Shared openings, copies, turnless conversations, null turns, roles and texts, ties, repeated rows and ids far apart."""
    rng = random.Random(seed)
    texts = ["", "a", "b" * 7, "é", None, "x:y", "long " * 300]
    rows = []
    for c in [*range(25), 100, 101, 102, 103, 107, 205, 207, -3, -150, 10**12 + 7, None]:
        for k in range(rng.choice([1, 2, 3, 9, 20])):
            rows.append((c, rng.choice([k, k, k, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    copy = [(t, r, x) for c, t, r, x in rows if c == 100]
    rows += [(c, *t) for c in range(300, 330) for t in copy] + rows[:9]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = some_rows(seed)
    assert result(spark, rows) == brute(rows)


def test_pieces_of_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 1)
    rows = [(c, k if c % 3 else None, "user", f"t{k if k < 40 or c < 4 else c}") for c in range(7) for k in range(60)] + some_rows(3)
    assert result(spark, rows) == brute(rows)


def test_digests_of_many_ends_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        ends = spark.range(50).selectExpr("1L depth", "if(id % 5 < 3, 7L, id % 5) key1", "0L key2", "id conv_id")
        got = {r.key1: (r.n_ends, r.ends_sha256) for r in prefix_trie.end_digests(ends).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = {}
    for i in range(50):
        groups.setdefault(7 if i % 5 < 3 else i % 5, []).append(str(i))
    assert got == {k: (len(v), hashlib.sha256(",".join(v).encode()).hexdigest()) for k, v in groups.items()}


def test_empty_and_turnless(spark):
    assert result(spark, []) == set()
    lone = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6)]
    assert result(spark, lone) == brute(lone)
    assert {r[1] for r in brute([(c, 0, "u", "x") for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6])} == {0}


def test_query_ignores_other_columns(spark, tmp_path):
    rows = [(*r, 5, "z") for r in some_rows(4)[:60]]
    spark.createDataFrame(rows, SCHEMA + ", block long, key1 string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in op12_prefix_trie(spark, str(tmp_path)).collect()} == brute([r[:4] for r in rows])
