import hashlib
import random
import re
import time

import numpy as np
import pytest

from furrow.llm.frames import table
from furrow.llm.personal_data import (
    CARD, EMAIL, IP, KINDS, PHONE, base_spans, examples, features, find, fit_model, learn, luhn, op11_personal_data, proposals, redacted, respelt, select,
)

# The contract's patterns as they stand.
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((list(KINDS).index(kind), *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def card(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def one(kind, rng):
    return [f"{rng.choice(['ann', 'jo.b', 'x+y'])}{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.{rng.choice(['com', 'org'])}",
            ".".join(str(rng.randint(0, 255)) for _ in range(4)), card(rng),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"][kind]


def prose(rng, n=60):
    words = rng.choices("the of and at house river dot mill, bread. 12 2024 3.5 10:30 market; day (town) 1,000 555-1234 people".split(), k=n)
    for _ in range(rng.choice([0, 0, 1, 2, 3])):
        words[rng.randrange(n)] = one(rng.randrange(4), rng)
    return " ".join(words)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(1)
    for k in range(4_000):
        text = "".join(rng.choices(["a", "@", ".", "-", "+", "1", "22", "333", "4444", " ", "(", ")", "é", "@b.c", "1.2.3.4", card(rng), "+1 23", "\n"], k=rng.randint(0, 25)))
        assert base_spans(text) == plain(text), text
    for k in range(300):
        text = prose(rng)
        assert base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 150_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "+1(((" * 60_000, "a@b." * 75_000, " at a" * 60_000, "1.1.1.1 " * 40_000])
def test_scanning_is_linear(text):
    start = time.perf_counter()
    base_spans(text)
    proposals(text)
    assert time.perf_counter() - start < 10


def test_respellings_are_proposed():
    rng = random.Random(2)
    missed = 0
    for k in range(400):
        kind = k % 4
        said, _ = respelt(one(kind, rng), kind, rng)
        missed += (kind, 5, 5 + len(said)) not in proposals(f"with {said} in town")
    assert missed <= 8


def model_of(seed, n=800):
    rng = random.Random(seed)
    rows = [(label, x, k % 5 == 0) for k in range(n) for label, x in examples(prose(rng))]
    return fit_model(np.array([r[1] for r in rows], dtype=float), np.array([r[0] for r in rows], dtype=float), np.array([r[2] for r in rows]))


def test_model_adds_respellings_and_nothing_else():
    model, rng = model_of(3), random.Random(4)
    caught = wrong = 0
    for k in range(400):
        kind = k % 4
        good, bad = respelt(one(kind, rng), kind, rng)
        text = f"{prose(rng, 20)} with {good} in town"
        at = text.index(good)
        (base, added), = select([text], model)
        caught += any(s[:2] == (kind, at) or s[0] == kind and s[1] <= at + 1 and at + len(good) <= s[2] + 1 for s in base + added)
        (base, added), = select([f"the market of {bad} and people"], model)
        wrong += bool(added)
    assert caught >= 300 and wrong <= 20
    (base, added), = select(["on 2024-01-12 at 10:30 the mill. Bread at house. 555-1234 and 1,000 people"], model)
    assert not base and not added


def test_added_spans_overlap_nothing():
    model, rng = model_of(5, 300), random.Random(6)
    for _ in range(200):
        text = prose(rng) + " " + respelt(one(2, rng), 2, rng)[0]
        (base, added), = select([text], model)
        assert base == base_spans(text)
        for s in added:
            assert not any(t is not s and t[1] < s[2] and s[1] < t[2] for t in base + added)


def test_redaction_covers_overlapping_spans():
    assert redacted("call +1 (555) 555-1234 or ann@x.org", [(PHONE, 5, 22), (EMAIL, 26, 35), (CARD, 8, 22)]) == "call [PHONE] or [EMAIL]"
    assert redacted("", []) == "" and redacted("1.2.3.4", [(IP, 0, 7)]) == "[IP]"


def test_without_examples_nothing_is_added(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "no numbers")], "doc_id long, text string")
    model = learn(docs)
    assert (model.threshold > 1).all() and model.probability(np.array([features("x", (0, 0, 1))])).shape == (1,)
    assert learn(docs.limit(0)).threshold.min() > 1
    assert find(docs.limit(0), model).count() == 0


def test_odd_rows_and_clashing_columns(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng)) for k in range(400)] + [(None, "ann1@mail1.example.com"), (7, None), (7, ""), (8, "1.2.3.4 " + "long text " * 200_000 + "1.2.3.4")] * 2
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, base string, start int")
    got = find(docs, learn(docs))
    assert got.columns == ["doc_id", "text", "start", "base", "added", "redacted"]
    for r in got.collect():
        assert [(KINDS.index(s.kind), s.start, s.end) for s in r.base] == plain(r.text or "")
        assert not any(KINDS[s[0]] == "email" for s in plain(r.redacted))


def test_query_against_plain_patterns(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = op11_personal_data(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        said = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in range(4)]
        assert len(r.spans.split(",") if r.spans else []) == len(want) + r.n_added
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
