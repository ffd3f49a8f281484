"""Operator 1: quality rules by distribution divergence.

A document's histogram of character classes and its histogram of common words are held against the histograms of its
language by the Jensen-Shannon distance (base 2, 0 to 1). The language references are sums over all documents of that
language that pass the base rules. Only texts with enough words are judged, and only against a reference with enough.

All of it is DataFrame expressions. A document's words never leave its row; what is shuffled are the sums by language
(a row for each language and task), and the reference table has a row for each language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm import common
from emberline.llm.op05_mix import SPLIT
from emberline.storage import materialize

#: Frequent function words of English, German, French and Spanish, of four letters at most.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "ist",
    "le", "la", "et", "les", "des", "un", "une", "est", "pour", "dans",
    "el", "que", "y", "los", "se", "del", "las", "por", "con", "para",
)
WIDEST = max(map(len, COMMON))
#: Words a text needs before each histogram is judged; words a reference needs.
LEAST_WORDS_CLASSES, LEAST_WORDS_COMMON, LEAST_REFERENCE = 50, 80, 1000
#: Distances above which a text is rejected: either one alone, or both together.
MOST_CLASSES, MOST_COMMON = 0.30, 0.42
BOTH_CLASSES, BOTH_COMMON = 0.14, 0.25
SYMBOLS = r"#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more. Windows are sorted with their positions by a
    64-bit hash; texts without equal windows are settled by the count of distinct ones."""
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  evaluates x once, where a lambda would for each element

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        equal = lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
        at = F.sort_array(F.transform(bound(pairs, equal), lambda x: x["i"]))
        steps = lambda a: F.zip_with(a, F.slice(a, 2, F.size(a)), lambda x, y: F.coalesce(F.least(F.lit(3), y - x), F.lit(3)))
        return F.aggregate(bound(at, lambda a: F.when(F.size(a) > 0, steps(a)).otherwise(F.array().cast("array<int>"))), F.lit(0), lambda s, x: s + x)

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
        return F.when(F.size(w) >= 3, bound(grams, count)).otherwise(0)

    return bound(words, of).cast("long")


def measured(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``carry`` and the counts of every row's text, ``base_failed`` and the two histograms. Null or empty text: no words."""
    only = lambda c, keep: F.length(F.regexp_replace(c, f"[^{keep}]+", "")).cast("long")
    t, words = F.col("_text"), F.col("_words")
    rows = docs.select(*carry, F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split(t, SPLIT), ""))
    places = F.array(*(F.lit(w) for w in COMMON))
    found = F.filter(F.transform(words, lambda w: F.when(F.length(w) <= WIDEST, F.array_position(places, w)).otherwise(0)), lambda k: k > 0)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_words = F.size(words).cast("long")
    rows = rows.select(
        *carry, "_lang",
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("_length"),
        only(t, SYMBOLS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).alias("n_repeat_words"),
        only(t, r"\p{Lu}").alias("_upper"), only(t, "0-9").alias("_digit"), only(t, r".,;:!?'\"()\-").alias("_punct"),
        found.alias("_found"),
    )
    rest = F.col("word_chars") - F.col("n_symbols") - F.col("_upper") - F.col("_digit") - F.col("_punct")
    hits = [F.size("_found") - F.size(F.array_remove("_found", F.lit(k + 1))) for k in range(len(COMMON))]
    return rows.select(
        *carry, "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.array(rest, F.col("_length") - F.col("word_chars"), "_upper", "_digit", "_punct", "n_symbols").alias("_classes"),
        F.array(*hits, F.col("n_words") - F.size("_found")).cast("array<long>").alias("_common"),
    )


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of counts (null if either has none)."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)
    half = lambda p, m: F.when(p > 0, p * F.log2(p / m) / 2).otherwise(0.0)
    terms = F.zip_with(a, b, lambda x, y: F.struct((x / F.col("_na")).alias("p"), (y / F.col("_nb")).alias("q")))
    parts = F.transform(terms, lambda t: half(t["p"], (t["p"] + t["q"]) / 2) + half(t["q"], (t["p"] + t["q"]) / 2))
    summed = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))
    return summed, total(a), total(b)


def _with_distance(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    value, na, nb = distance(F.col(a), F.col(b))
    return rows.withColumns({"_na": na, "_nb": nb}).withColumn(name, F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.round(value, 6))).drop("_na", "_nb")


def judge(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``carry``, the base counts, ``base_failed``, both distances and ``kept``, a row for each input row.

    A distance is null and rejects nothing where the text has too few words or its language too few to refer to. Null
    languages share one reference. Null or empty text fails the base rules. Equal rows get equal verdicts; an empty
    table gives an empty result; other columns aren't read.
    """
    rows = materialize(measured(docs, carry, text_col, lang_col), "measured")
    sums = lambda c, n: [F.sum(F.when(~F.col("base_failed"), F.get(c, F.lit(k))).otherwise(0)) for k in range(n)]
    reference = materialize(rows.groupBy("_lang").agg(
        F.array(*sums("_classes", 6)).alias("_ref_classes"),
        F.array(*sums("_common", len(COMMON) + 1)).alias("_ref_common"),
        F.sum(F.when(~F.col("base_failed"), F.col("n_words")).otherwise(0)).alias("_ref_words"),
    ), "reference")
    rows = rows.join(reference, "_lang")
    rows = _with_distance(_with_distance(rows, "_classes", "_ref_classes", "class_distance"), "_common", "_ref_common", "word_distance")
    known = F.col("_ref_words") >= LEAST_REFERENCE
    rows = rows.withColumns({
        "class_distance": F.when(known & (F.col("n_words") >= LEAST_WORDS_CLASSES), F.col("class_distance")),
        "word_distance": F.when(known & (F.col("n_words") >= LEAST_WORDS_COMMON), F.col("word_distance")),
    })
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    near = (by_class <= MOST_CLASSES) & (by_word <= MOST_COMMON) & ~((by_class > BOTH_CLASSES) & (by_word > BOTH_COMMON))
    return rows.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & near).alias("kept"), "class_distance", "word_distance",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


def _sql_distance(a: str, b: str) -> str:
    p, q = f"(x.a::DOUBLE / list_sum({a}))", f"(x.b::DOUBLE / list_sum({b}))"
    half = lambda v: f"(CASE WHEN {v} > 0 THEN {v} * log2({v} / (({p} + {q}) / 2)) / 2 ELSE 0 END)"
    terms = f"list_transform(list_zip({a}, {b}), lambda y: struct_pack(a := y[1], b := y[2]))"
    return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN round(sqrt(greatest(0, list_sum(list_transform({terms}, lambda x: {half(p)} + {half(q)})))), 6) END"


_WORDS = ", ".join(f"'{w}'" for w in COMMON)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, unnest(list_transform(range(1, len(words) - 1), lambda k: words[k:k+2])) AS gram FROM w),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) AS n,
    length(regexp_replace(text, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digit,
    length(regexp_replace(text, '[^.,;:!?''"()\-]+', '', 'g')) AS punct,
    list_transform([{_WORDS}], lambda c: len(list_filter(words, lambda x: x = c))) AS hits
  FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [word_chars - n_symbols - upper - digit - punct, n - word_chars, upper, digit, punct, n_symbols] AS classes,
    list_append(hits, n_words - list_sum(hits)) AS words FROM m),
f AS (SELECT lang, {", ".join(f"sum(CASE WHEN base_failed THEN 0 ELSE classes[{k}] END)::BIGINT AS c{k}" for k in range(1, 7))},
    {", ".join(f"sum(CASE WHEN base_failed THEN 0 ELSE words[{k}] END)::BIGINT AS w{k}" for k in range(1, len(COMMON) + 2))},
    sum(CASE WHEN base_failed THEN 0 ELSE n_words END)::BIGINT AS ref_words FROM b GROUP BY lang),
h AS (SELECT lang, ref_words, [{", ".join(f"c{k}" for k in range(1, 7))}] AS ref_classes, [{", ".join(f"w{k}" for k in range(1, len(COMMON) + 2))}] AS ref_common FROM f),
j AS (SELECT b.*, CASE WHEN ref_words >= {LEAST_REFERENCE} AND n_words >= {LEAST_WORDS_CLASSES} THEN {_sql_distance("classes", "ref_classes")} END AS class_distance,
    CASE WHEN ref_words >= {LEAST_REFERENCE} AND n_words >= {LEAST_WORDS_COMMON} THEN {_sql_distance("words", "ref_common")} END AS word_distance FROM b JOIN h USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {MOST_CLASSES} AND coalesce(word_distance, 0) <= {MOST_COMMON}
  AND NOT (coalesce(class_distance, 0) > {BOTH_CLASSES} AND coalesce(word_distance, 0) > {BOTH_COMMON}) AS kept, class_distance, word_distance FROM j
"""
