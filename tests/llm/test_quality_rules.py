import random
import re
from collections import Counter

from furrow.llm.quality_rules import cascade, quality, rules, with_base_counts

SCHEMA = "doc_id long, text string"
PROSE = "the old mill stood by a river and it was known for bread that people in town liked to buy on market days with butter".split()
CLEAN = " ".join(random.Random(8).choices(PROSE, k=120))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))
    return (*counts, len(words) < 50 or 100 * len(inside) > 50 * len(words))


TEXTS = [None, "", " \n\t\x0b ", "a", "a b", "a b c", "a b c a b c", "x " * 60, CLEAN, CLEAN.upper(), CLEAN.replace(" ", "### "), "\n".join([CLEAN[:200]] * 6), "été " * 3 + CLEAN, "𝒳 " * 5, CLEAN + "\n" + CLEAN,
         " ".join(f"w{i}" for i in range(100)), " ".join(f"{i}-{i}" for i in range(100)) + " the of and", "y" * 300_000, "a\r\nb\r\nb\r\n", " ".join(f"k{i % 997}" for i in range(60_000))]


def test_base_counts(spark):
    rows = list(enumerate(TEXTS)) + [(8, CLEAN), (None, CLEAN)]
    got = with_base_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text and r.text[:40]


def test_verdicts(spark):
    got = {r.text: r.rejected_by for r in quality(spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)).collect()}
    assert got[CLEAN] is None and got["été " * 3 + CLEAN] is None
    assert got[CLEAN.upper()] == "capitals" and got[CLEAN.replace(" ", "### ")] in ("symbols", "few_letters")
    assert got[" ".join(f"w{i}" for i in range(100))] in ("no_frequent_words", "few_letters")  # it fails both
    assert got[None] == got[""] == got["a b c"] == "base"


def test_runs_agree(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    first, second = (sorted((r.doc_id, r.rejected_by or "") for r in quality(docs.repartition(n)).collect()) for n in (1, 5))
    assert first == second


def test_order_changes_no_verdict(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    first = {r.doc_id: r.kept for r in quality(docs).collect()}
    monkeypatch.setattr("furrow.llm.quality_rules.cascade", lambda sample, candidates: sorted(candidates, reverse=True))
    assert {r.doc_id: r.kept for r in quality(docs).collect()} == first


def test_cascade_puts_rejections_first(spark):
    sample = with_base_counts(spark.createDataFrame([(k, CLEAN.replace(" ", "### ")) for k in range(40)], SCHEMA))
    assert cascade(sample, {k: v for k, v in rules().items() if k in ("capitals", "symbols")})[0] == "symbols"


def test_clashing_columns_and_no_rows(spark):
    clash = spark.createDataFrame([(1, CLEAN, "x", 2, 3, 4)], "doc_id int, text string, kept string, n_words int, _words int, n_lines int")
    r = quality(clash).collect()[0]
    assert r.kept is True and r.n_words == base(CLEAN)[0]
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0
