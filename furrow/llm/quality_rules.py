"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are made for every text. The rules beyond them look at the text again; their order comes from a sample, in which each rule's
rejections and its cost, counted as the characters it looks at, are added up: rules with the most rejections per cost go first. A row that a rule
rejects is not looked at by later ones, as CASE WHEN stops at the first true condition. The order never changes which rows are kept; it is the
same in every run over the same rows, and so is rejected_by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.frames import once, table

#: About so many rows, chosen by a hash, order the rules; they have no other use.
SAMPLE_ROWS = 2_000
FEWEST_WORDS = 50
SPACES = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

# Frequent short words of the languages expected; a text of 50 words and more holds several of them.
FREQUENT_WORDS = ("the of and to in is that for on with was by as at from this it be are a an or not have has "
                  "der die das und in von den mit ist ein eine nicht zu im auf für des sich dem auch "
                  "le la les de des et un une en que qui dans est pour du au par sur pas plus "
                  "el los las y un una del se con por para su al es lo como o no más").split()


def _repeat_words(words: Column) -> Column:
    """Words inside the 3-word windows that occur twice or more."""
    def spread(windows: Column) -> Column:
        def places(ordered: Column) -> Column:
            def again(x: Column, i: Column) -> Column:
                return ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return once(F.sort_array(F.transform(F.filter(ordered, again), lambda x: x["i"])), covered)

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), once(F.sort_array(placed), places)).otherwise(0)
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) >= 4, once(windows, spread)).otherwise(0)


def with_base_counts(docs: DataFrame) -> DataFrame:
    """The rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), n_lines and base_failed.

    A null text has no words. 3-word windows are told apart by 64-bit hashes within their text.
    """
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "_body", "_words", "_lines"]
    body = docs.drop(*own).withColumn("_body", F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = body.withColumn("_words", F.array_remove(F.split("_body", SPACES), "")) \
        .withColumn("_lines", F.filter(F.split("_body", "\n"), lambda line: F.translate(line, BLANKS, "") != ""))
    chars = F.length("_body")
    counted = cut.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_body", BLANKS, "")).cast("long"),
        "n_symbols": (chars - F.length(F.translate("_body", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": once(F.col("_words"), _repeat_words).cast("long"),
    })
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).drop("_lines")


def rules() -> dict[str, Column]:
    """What each rule rejects; columns of with_base_counts."""
    letters = F.length(F.regexp_replace("_body", r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace("_body", r"\P{Lu}+", ""))
    return {
        "symbols": 100 * F.col("n_symbols") > 20 * F.col("n_words"),
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "few_letters": 100 * letters < 60 * F.col("word_chars"),
        "capitals": 100 * capitals > 40 * F.col("word_chars"),
        "no_frequent_words": F.size(F.array_intersect(F.transform("_words", lambda w: F.lower(w)), F.array(*[F.lit(w) for w in dict.fromkeys(FREQUENT_WORDS)]))) < 2,
    }


def costs() -> dict[str, Column]:
    """What each rule looks at, in characters; comparing counts that are there already costs one."""
    whole = F.length("_body") + 1
    return {"few_letters": whole, "capitals": whole, "no_frequent_words": 2 * whole}


def cascade(sample: DataFrame, candidates: dict[str, Column]) -> list[str]:
    """The rules' names, most rejections per cost first; equal ones, and all on an empty sample, by name."""
    cost = costs()
    row = sample.agg(*[F.count_if(rejects).alias(f"n_{name}") for name, rejects in candidates.items()],
                     *[F.sum(cost.get(name, F.lit(1))).alias(f"cost_{name}") for name in candidates]).first()
    return sorted(candidates, key=lambda name: (-row[f"n_{name}"] / max(row[f"cost_{name}"] or 0, 1), name))


def quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs with the base counts, base_failed, rejected_by (the first rule in the cascade's order, null if none) and kept.

    Every row is returned, also repeated ones and those without a doc_id. A text that is null, empty or under 50 words fails the
    base. Columns of docs that have a name given here are replaced.
    """
    counted = with_base_counts(docs.drop("rejected_by", "kept"))
    candidates = rules()
    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.select("text").filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34) < int(share * 2**30))
    order = cascade(with_base_counts(some).filter(~F.col("base_failed")), candidates)
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(candidates[name], name)
    return counted.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull()).drop("_body", "_words", "n_lines")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     c AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM c WHERE len(w) >= 3),
     h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM g),
     r AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM h WHERE n > 1) GROUP BY 1),
     b AS (SELECT c.doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM c LEFT JOIN r USING (doc_id)),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 100 * length(regexp_replace(t, '\P{L}+', '', 'g')) < 60 * word_chars
            OR 100 * length(regexp_replace(t, '\P{Lu}+', '', 'g')) > 40 * word_chars
            OR len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), [FREQUENT])) < 2) AS kept
FROM f
""".replace("FREQUENT", ", ".join(f"'{w}'" for w in dict.fromkeys(FREQUENT_WORDS)))

QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": SQL}
