"""Style measures per text (A1, A2, A4-A6, A10-A14, R1-R3, D20, W1, W3, W6, W12, W13), as expressions of one row.

Counts come out as integers and ratios as one division of integers, unrounded.  Texts are cleaned of noise lines
first.  Null, empty and blank texts give zero counts; ratios without a denominator are computed over at least 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.text import count, count_chars, count_words, pieces, strip, total
from inkmill.operators.noise import with_clean


def prepared(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, clean, paragraph lengths and sentences of every text."""
    clean = with_clean(df.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    kept = F.filter(F.transform("lines", lambda x: F.length(strip(x["out"])).cast("long")), lambda n: n > 0)
    return clean.select(*keys, "clean", F.length("clean").cast("long").alias("total_chars"), kept.alias("paras"), pieces(F.col("clean"), L.SENTENCE).alias("sents"))


def lengths(a: Column) -> Column:
    return F.transform(a, lambda s: F.length(s).cast("long"))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def _between(a: str, low: int, high: int) -> Column:
    return F.size(F.filter(a, lambda x: (x > low) & (x <= high))).cast("long")


def _equal(a: str, value: str) -> Column:
    return F.size(F.filter(a, lambda x: x == value)).cast("long")


def style_core(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    base = prepared(df, keys, text).withColumn("lens", lengths(F.col("sents")))
    size = lambda a: F.size(a).cast("long")
    out = base.select(
        *keys, "total_chars",
        size("paras").alias("n_paragraphs"), total(F.col("paras")).alias("paragraph_chars"), size(F.filter("paras", lambda n: n <= 8)).alias("short_paragraphs"),
        size("sents").alias("n_sentences"), total(F.col("lens")).alias("sentence_chars"), size(F.filter("lens", lambda n: n <= 10)).alias("short_sentences"), size(F.filter("lens", lambda n: n >= 50)).alias("long_sentences"),
        *[count(F.col("clean"), p).alias(f"n_{k}") for k, p in L.PUNCTUATION.items()],
    )
    avg = ratio(F.col("sentence_chars"), F.col("n_sentences"))
    return out.select(
        "*", avg.alias("avg_sentence"), ratio(F.col("paragraph_chars"), F.col("n_paragraphs")).alias("avg_paragraph"), ratio(F.col("n_comma"), F.col("n_period")).alias("comma_per_period"),
        F.when(avg < 18, "very_short").when(avg < 25 + 1e-9, "short").when(avg < 35 + 1e-9, "medium").otherwise("long").alias("length_bracket"),
    )


def sentence_stats(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Median, extremes and population deviation of sentence lengths, and counts by length band."""
    base = prepared(df, keys, text).select(*keys, F.array_sort(lengths(F.col("sents"))).alias("v")).withColumn("n", F.size("v").cast("long"))
    n, s, q = F.col("n"), total(F.col("v")), total(F.transform("v", lambda x: x * x))
    at = lambda i: F.element_at("v", i.cast("int"))
    median = F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0)
    bands = [("le10", 0, 10), ("le20", 10, 20), ("le30", 20, 30), ("le50", 30, 50), ("more", 50, 10**9)]
    return base.select(
        *keys, n.alias("n_sentences"), median.cast("double").alias("median_length"), F.when(n > 0, at(F.lit(1))).alias("min_length"), F.when(n > 0, at(n)).alias("max_length"),
        F.when(n > 0, F.sqrt((n * q - s * s).cast("double")) / n.cast("double")).alias("deviation"),
        *[_between("v", a, b).alias(f"n_{k}") for k, a, b in bands],
    )


def rhetoric(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Scene cues, rhetorical questions, parallel phrases and persons."""
    c = F.col("clean")
    plain = F.replace(F.replace(c, F.lit("其他"), F.lit("")), F.lit("其它"), F.lit(""))
    third, first = count_chars(plain, L.THIRD), count_chars(plain, L.FIRST) + count_words(plain, L.FIRST_WORDS)
    mine, theirs = count_chars(c, L.FIRST), count_chars(c, L.THIRD) + count_words(c, ["他们", "她们"])
    out = prepared(df, keys, text).select(
        *keys, (count(c, L.SCENE_TIME) + count(c, L.SCENE_MOVE)).alias("scene_cues"), count(c, L.RHETORICAL).alias("rhetorical_questions"), count(c, L.PARALLEL).alias("parallel_phrases"),
        third.alias("third_person"), first.alias("first_person"), mine.alias("first_markers"), theirs.alias("third_markers"),
    )
    a, b = F.col("first_markers"), F.col("third_markers")
    return out.select(
        "*", F.when(F.col("third_person") >= 2 * F.col("first_person"), "third").when(F.col("first_person") > F.col("third_person"), "first").otherwise("mixed").alias("person"),
        F.when(a + b == 0, "none").when(4 * F.greatest(a, b) > 3 * (a + b), "stable").otherwise("shifting").alias("person_stability"),
    )


def is_simile(s: Column) -> Column:
    """An explicit comparison: a marker word, or a bare 如 or 像 before a noun phrase and not in a fixed compound."""
    rest = F.regexp_replace(s, L.NOT_LIKE, "")
    idiom = rf"(?:一(?:[^\x{{4e00}}-\x{{9fa5}}]|$|[{L.RU_ONE}])|既往|往[日前昔常]|从[前来])"
    return rest.rlike("|".join(L.SIMILE_MARKERS) + rf"|(?<![{L.RU_BEFORE}])如(?![{L.RU_AFTER}])(?!{idiom})(?={L.CJK})|(?<![{L.XIANG_BEFORE}])像(?={L.CJK})")


def similes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentences of 8 to 80 characters that hold a simile."""
    trimmed = F.filter(F.transform("sents", lambda s: F.regexp_replace(s, "^[，、；：]+|[，、；：]+$", "")), lambda s: F.length(s).between(8, 80))
    return prepared(df, keys, text).select(*keys, F.size(F.filter(trimmed, is_simile)).cast("long").alias("similes"), "total_chars")


def description_mix(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentences by what they describe most: action, mind or scenery (the last only with two words and a clear lead)."""

    def label(s: Column) -> Column:
        a = count_chars(s, L.ACTION_CHARS) + count_words(s, L.ACTION_WORDS)
        m = count_chars(s, L.MENTAL_CHARS) + count_words(s, L.MENTAL_WORDS)
        e = count_chars(s, L.SCENERY_CHARS)
        return F.struct(a.alias("a"), m.alias("m"), e.alias("e"))

    def kind(x: Column) -> Column:
        a, m, e = x["a"], x["m"], x["e"]
        return F.when((e > F.greatest(a, m)) & (e >= 2), "scenery").when(F.greatest(a, m, e) == 0, "none").when((a >= m) & (a >= e), "action").when(m >= e, "mind").otherwise("scenery")

    kinds = F.transform(F.transform("sents", label), kind)
    out = prepared(df, keys, text).select(*keys, kinds.alias("k"))
    out = out.select(*keys, *[_equal("k", n).alias(n) for n in ("action", "mind", "scenery")])
    r = ratio(F.col("action"), F.col("mind"))
    return out.select("*", r.alias("action_per_mind"), F.when(r >= 3, "action").when(r >= 1.2, "balanced").otherwise("mind").alias("driver"))


def low_level(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Readability, word lengths, clauses and sentiment over fallback tokens (overlapping pairs of each Han run)."""
    clean = prepared(df, keys, text)
    runs = F.transform(F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0)), lambda r: F.length(r).cast("long"))
    pairs, odd = total(F.transform(runs, lambda n: n - 1)), total(F.transform(runs, lambda n: n % 2))
    sents = pieces(F.col("clean"), L.LOW_SENTENCE)
    base = clean.select(*keys, "clean", "total_chars", pairs.alias("words_2"), odd.alias("words_1"), sents.alias("s"))
    clauses = F.transform("s", lambda x: F.greatest(F.size(pieces(x, L.CLAUSE)), F.lit(1)).cast("long"))
    out = base.select(
        *keys, "total_chars", (F.col("words_1") + F.col("words_2")).alias("n_words"), (F.col("words_1") + 2 * F.col("words_2")).alias("word_chars"), F.size("s").cast("long").alias("n_sentences"),
        total(clauses).alias("n_clauses"), F.coalesce(F.array_max(clauses), F.lit(0)).alias("most_clauses"),
        total(F.transform("s", lambda x: count(x, L.SUBORDINATE))).alias("subordinate"), total(F.transform("s", lambda x: count(x, L.COORDINATE))).alias("coordinate"),
        F.size(F.filter(F.array(*map(F.lit, L.POSITIVE)), lambda w: F.contains(F.col("clean"), w))).cast("long").alias("positive"),
        F.size(F.filter(F.array(*map(F.lit, L.NEGATIVE)), lambda w: F.contains(F.col("clean"), w))).cast("long").alias("negative"),
        F.size(F.filter(F.array(*map(F.lit, L.SYSTEM_WORDS)), lambda w: F.contains(F.col("clean"), w))).cast("long").alias("system_words"),
    )
    asl, awl = ratio(F.col("total_chars"), F.col("n_sentences")), ratio(F.col("word_chars"), F.col("n_words"))
    score = F.when(asl < 15, 1).when(asl < 25, 2).when(asl < 40, 3).otherwise(4) + F.when(awl < 2, 1).when(awl < 3, 2).when(awl < 4, 3).otherwise(4) + 1
    p, n = F.col("positive"), F.col("negative")
    return out.select(
        "*", asl.alias("avg_sentence"), awl.alias("avg_word"), (F.lit(0.4) * asl).alias("yang_index"), F.greatest(F.lit(0.0), F.lit(0.39) * asl + F.lit(11.8) * awl - F.lit(15.59)).alias("grade_index"),
        (F.lit(0.4) * ratio(F.col("n_words"), F.col("n_sentences"))).alias("fog_index"),
        F.when(score * 2 < 9, "simple").when(score * 2 < 15, "medium").when(score * 2 < 21, "hard").otherwise("very_hard").alias("readability"),
        F.when(5 * (p - n) > p + n, "positive").when(5 * (n - p) > p + n, "negative").otherwise("neutral").alias("tone"),
    )


def fallback_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word): every overlapping pair of each Han run of two or more, and the last character of odd runs."""
    runs = prepared(df, keys, text).select(*keys, F.explode(F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0))).alias("r"))
    words = F.transform(F.sequence(F.lit(1), F.length("r") - 1), lambda i: F.substring(F.col("r"), i, F.lit(2)))
    last = F.when(F.length("r") % 2 == 1, F.array(F.substring(F.col("r"), F.length("r"), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return runs.select(*keys, F.explode(F.concat(words, last)).alias("word"))


def vocabulary_richness(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct, once, twice and oftener seen tokens per text; counts are combined map-side before the shuffle."""
    counts = fallback_tokens(df, keys, text).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    c = lambda cond: F.count_if(cond)
    n = F.col("n")
    out = counts.groupBy(*keys).agg(F.sum("n").alias("total_words"), F.count(F.lit(1)).alias("unique_words"), c(n == 1).alias("once"), c(n == 2).alias("twice"), c(n > 2).alias("oftener"), F.max("n").alias("most"))
    return out.select("*", ratio(F.col("unique_words"), F.col("total_words")).alias("type_token_ratio"))


def top_words(df: DataFrame, keys: list[str], text: str, most: int = 20) -> DataFrame:
    """The most frequent tokens of each text, ties by the token; single characters take a rank but are left out."""
    counts = fallback_tokens(df, keys, text).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "word"))).where((F.col("rank") <= most) & (F.length("word") > 1))
