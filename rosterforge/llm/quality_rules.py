"""Quality rules: counts of words, symbols and repeats, and the divergence of a text's histograms from those of its language. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, documents, whole, written

WINDOW = 8
FEWEST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "[#*$%&|<>]"
#: Character classes of the histogram. Consonants and all else but white space make up the last class, which needs no count of its own.
CLASSES = {"vowels": "[aeiou]", "capitals": "[A-Z]", "digits": "[0-9]", "beyond ASCII": r"[^\x00-\x7F]", "stops": "[.,;:'\"?()-]", "marks": "[!#*$%&|<>@=+~^_\\\\/{}\\[\\]]"}
# Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "for", "on", "that", "with", "was", "are"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "est", "que"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"),
}
#: A text is rejected if its two divergences (Jensen-Shannon, in bits) together are above MOST + SHORT / sqrt(words). Texts of fewer than GUARD_WORDS words say too little, and are not rejected by them.
MOST, SHORT, GUARD_WORDS = 0.08, 0.3, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once for each row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """The number of words that lie in a window of so many words which occurs twice or more, its first occurrence included.

    Windows are compared by 64-bit hashes of their words' hashes. Where two agree, windows are sorted with their places, and the places of those equal
    to a neighbour are joined: each covers the words up to the next such place, a whole window at most.
    """

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return let(F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"])), of_places)

        def of_places(p: Column) -> Column:
            steps = F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        entries = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(entries, of_sorted))

    def of_hashes(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - window)
        return let(F.transform(places, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window)))), covered)

    return F.when(F.size(words) < window, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).cast("long")


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the base counts, and the histograms: chars (of CLASSES, then all others) and common (of the language's COMMON words, then all others)."""
    split = docs.select(F.col(key).alias("doc_id"), F.col(lang).alias("lang"), whole(text).alias("text")).withColumn("words", F.array_remove(F.split("text", GAP), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = [F.regexp_count("text", F.lit(c)).cast("long") for c in CLASSES.values()]
    every = F.array(*[F.lit(w) for w in sorted({w for ws in COMMON.values() for w in ws})])
    heard = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: F.array_contains(every, w))
    of_lang = F.lit(None).cast("array<string>")
    for name, ws in COMMON.items():
        of_lang = F.when(F.col("lang") == name, F.array(*[F.lit(w) for w in ws])).otherwise(of_lang)
    by_lang = let(heard, lambda h: F.transform(of_lang, lambda c: F.size(F.filter(h, lambda w: w == c)).cast("long")))
    rest = lambda total, parts: F.concat(parts, F.array(total - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)))
    return split.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.array(*counted).alias("classes"), by_lang.alias("heard"),
    ).select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        let(F.col("classes"), lambda c: rest(F.col("word_chars"), c)).alias("chars"),
        let(F.col("heard"), lambda c: rest(F.col("n_words"), c)).alias("common"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence, in bits, of two histograms of equal length (counts); null if one is null or has no count."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def of_shares(s: Column) -> Column:
        half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
        both = lambda a, b: (half(a, (a + b) / 2) + half(b, (a + b) / 2)) / 2
        return total(F.zip_with(s["p"], s["q"], both))

    share = lambda x: F.transform(x, lambda v: v / total(x))
    return F.when((total(p) > 0) & (total(q) > 0), let(F.struct(share(p).alias("p"), share(q).alias("q")), of_shares))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, chars_divergence, words_divergence.

    base_failed: fewer than 20 words, or more than 30 percent of the words in repeated 8-word windows. kept: not base_failed, and the histograms are not further than MOST + SHORT / sqrt(words) from those of all the
    table's texts in the same language; of a language without a list of common words only characters are compared. A text without a language is compared with the whole table.
    So a verdict depends on the other texts of the table, junk among them. A text of fewer than GUARD_WORDS words is not judged by its histograms. A null text counts as
    empty (it fails the base rules); repeated rows give repeated rows, an empty table none; further columns are left out.
    """
    found = written(features(docs, key, text, lang), "quality-features")
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)) for k in range(n)])
    totals = [sums("chars", len(CLASSES) + 1).alias("all_chars"), sums("common", 13).alias("all_common")]
    by_lang = found.where("lang IS NOT NULL").groupBy("lang").agg(*totals).union(found.agg(F.lit(None).cast("string").alias("lang"), *totals))
    # written, so that its size is known when the join is planned: few languages are broadcast, and texts are not dealt out by language
    reference = written(by_lang.withColumnRenamed("lang", "of"), "quality-references")
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    judged = found.join(reference, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        *[c for c in found.columns if c not in ("lang", "chars", "common")],
        ((F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        divergence(doubles("chars"), doubles("all_chars")).alias("chars_divergence"),
        divergence(doubles("common"), doubles("all_common")).alias("words_divergence"),
    )
    far = F.coalesce("chars_divergence", F.lit(0.0)) + F.coalesce("words_divergence", F.lit(0.0)) > MOST + SHORT / F.sqrt("n_words")
    kept = ~F.col("base_failed") & ~((F.col("n_words") >= GUARD_WORDS) & far)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "chars_divergence", "words_divergence")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_divergence(a: str, b: str) -> str:
    """The divergence in SQL, of two lists."""
    p, q = f"x[1] / list_sum({a})", f"x[2] / list_sum({b})"
    half = lambda v: f"(CASE WHEN {v} > 0 THEN ({v}) * log2(({v}) / (({p} + {q}) / 2)) ELSE 0 END)"
    return f"coalesce(CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_sum(list_transform(list_zip({a}, {b}), lambda x: ({half(p)} + {half(q)}) / 2)) END, 0)"


def _sql() -> str:
    classes = [f"length(t) - length(regexp_replace(t, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in CLASSES.values()]
    common = " ".join(f"WHEN lang = '{name}' THEN {list(ws)}" for name, ws in COMMON.items())
    sums = lambda c, n: "[" + ", ".join(f"coalesce(sum({c}[{k}]), 0)::DOUBLE" for k in range(1, n + 1)) + "]"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: {{'i': i, 'w': array_to_string(ws[i:i + {WINDOW - 1}], ' ')}})) AS x FROM d),
again AS (SELECT doc_id, x.i AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x.w) AS n FROM starts) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM again) GROUP BY 1),
f AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, [{', '.join(classes)}] AS c, list_transform(CASE {common} END, lambda k: len(list_filter(ws, lambda w: lower(w) = k))) AS h FROM d LEFT JOIN covered USING (doc_id)),
g AS (SELECT *, list_transform(list_append(c, word_chars - list_sum(c)), lambda v: v::DOUBLE) AS chars, list_transform(list_append(h, n_words - list_sum(h)), lambda v: v::DOUBLE) AS common FROM f),
r AS (SELECT lang AS l, {sums('chars', len(CLASSES) + 1)} AS all_chars, {sums('common', 13)} AS all_common FROM g WHERE lang IS NOT NULL GROUP BY 1
  UNION ALL SELECT NULL, {sums('chars', len(CLASSES) + 1)}, {sums('common', 13)} FROM g),
j AS (SELECT g.*, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  {_sql_divergence('chars', 'all_chars')} AS a, {_sql_divergence('common', 'all_common')} AS b FROM g LEFT JOIN r ON l IS NOT DISTINCT FROM lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (n_words >= {GUARD_WORDS} AND a + b > {MOST} + {SHORT} / sqrt(n_words)) AS kept FROM j"""


OP5_SQL = _sql()
