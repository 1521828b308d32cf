import pytest
from test_decontamination import brute as leaks
from test_near_copies import brute as near
from test_source_mix import brute as mixed

import corpus_pipeline
from furrow.llm.frames import fold, table
from furrow.llm.language_id import identify, learn

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_of_each_group(rows):
    low = dict(near([r[:2] for r in rows]))
    return [r for r in rows if low[r[0]] == r[0]]


def without_repeats(rows, window=20):
    seen, out = set(), []
    for d, text, *rest in sorted(rows):
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone[i:i + window] = [True] * window
            seen.add(run)
        if any(gone):
            text = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        if not any(gone) or not all(gone):
            out.append((d, text, *rest[:2], len(text)))
    return out


def test_run_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    told = identify(docs, learn(docs.filter(fold("doc_id", 4) != 2))).collect()
    sure = {r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.5}
    rows = without_repeats(one_of_each_group([r for r in rows if r[0] in sure]))
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    bad = {d for d, _ in leaks([r[:2] for r in rows], items)}
    assert bad
    want, _ = mixed([(r[0], r[1], r[3]) for r in rows if r[0] not in bad])
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got), key=repr) == [w for w in want if w[4] > 0]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = "the house of the people was by the river and it is on the way to the town with a mill"
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, prose, "en", "a", 80), (3, prose, "en", "a", 80), (None, prose + " now", "en", "b", 1), (None, None, None, None, None),
            (4, "der die und das ist nicht mit einer " * 3000, "de", "b", None), (5, "!!! 123 ...", "en", "a", 9), (6, prose.upper() + " Hm", "en", "a", 2)]
    out = stage(spark, spark.createDataFrame(rows, SCHEMA), sf)
    got = out.collect()
    assert got
    if name != "source_mix":
        assert out.columns == COLUMNS
        assert any(r.doc_id == 4 for r in got)
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0


def test_near_copies_leave_one(spark, sf):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(k, text, "en", "a", 1) for k in (9, 4, 7)] + [(None, text, "en", "a", 1), (20, text[::-1], "en", "a", 1)]
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, SCHEMA), sf).collect()
    assert sorted(r.doc_id for r in got) == [4, 20]


def test_repeated_ids_and_clashing_columns(spark, sf):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text + " b", "x", {"a": 1}), (5, text + " a", "y", None), (8, "other words here " * 9, "z", {"b": 2}), (8, "third text at all " * 9, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string, more map<string, int>")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text[:6], r._key) for r in got.collect()) == [(5, text[:6], "y"), (8, "other ", "z")]
