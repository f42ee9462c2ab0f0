"""Ratios, levels and labels over one text (A3, A7-A9, A16, A17, W2-W5, W7-W11, T2, T3, K1-K4, G14), as expressions of one row.

Ratios are unrounded.  Null and empty texts have a row like all others: zero counts, ratios over at least 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.text import count, count_chars, count_word, count_words, pieces, strip, total
from inkmill.operators.style import _equal, is_simile, prepared, ratio


def per_thousand(c: Column, chars: str = "total_chars") -> Column:
    return c * F.lit(1000.0) / F.greatest(F.col(chars), F.lit(1)).cast("double")


def quoted_chars(clean: Column) -> Column:
    """Characters inside quotations, without space at their ends."""
    return total(F.transform(F.regexp_extract_all(clean, F.lit(L.QUOTE), F.lit(0)), lambda x: F.length(strip(F.substring(x, F.lit(2), F.length(x) - 2))).cast("long")))


def simile_count(sents: str) -> Column:
    trimmed = F.filter(F.transform(sents, lambda s: F.regexp_replace(s, "^[，、；：]+|[，、；：]+$", "")), lambda s: F.length(s).between(8, 80))
    return F.size(F.filter(trimmed, is_simile)).cast("long")


def style_densities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Densities per thousand characters, and shares."""
    c = F.col("clean")
    base = prepared(df, keys, text).select(
        *keys, "total_chars", *[count(c, p).alias(f"n_{k}") for k, p in L.PUNCTUATION.items()], (count(c, L.SCENE_TIME) + count(c, L.SCENE_MOVE)).alias("scene_cues"), simile_count("sents").alias("similes"), quoted_chars(c).alias("quoted"),
    )
    return base.select(
        *keys, *[per_thousand(F.col(f"n_{k}")).alias(f"{k}_density") for k in L.PUNCTUATION], per_thousand(F.col("n_exclamation") + F.col("n_question")).alias("excl_ques_density"),
        ratio(F.col("n_comma"), F.col("n_period")).alias("comma_per_period"), per_thousand(F.col("scene_cues")).alias("scene_density"), per_thousand(F.col("similes")).alias("simile_density"), ratio(F.col("quoted"), F.col("total_chars")).alias("quoted_share"),
    )


def described(s: Column) -> Column:
    """Words of action, mind and scenery in a sentence."""
    return F.struct((count_chars(s, L.ACTION_CHARS) + count_words(s, L.ACTION_WORDS)).alias("a"), (count_chars(s, L.MENTAL_CHARS) + count_words(s, L.MENTAL_WORDS)).alias("m"), count_chars(s, L.SCENERY_CHARS).alias("e"))


def leading(x: Column) -> Column:
    """What a sentence describes most: 1 action, 2 mind, 3 scenery, 0 nothing."""
    a, m, e = x["a"], x["m"], x["e"]
    return F.when((e > F.greatest(a, m)) & (e >= 2), 3).when(F.greatest(a, m, e) == 0, 0).when((a >= m) & (a >= e), 1).when(m >= e, 2).otherwise(3)


def measures(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """What markers, signals and labels read: shares in percent, densities per thousand characters, null where unmeasured."""
    c = F.col("clean")
    tokens = F.transform(F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    some = lambda items: F.size(F.filter(F.array(*map(F.lit, items)), lambda w: F.contains(c, w)))
    share = lambda a, cond: F.size(F.filter(a, cond)) * F.lit(100.0) / F.greatest(F.size(a), F.lit(1)).cast("double")
    base = prepared(df, keys, text).withColumn("lens", F.transform("sents", lambda s: F.length(s).cast("long"))).withColumn("kinds", F.transform(F.transform("sents", described), leading)).withColumn("words", F.flatten(tokens))
    base = base.select(
        *keys, "total_chars", share(F.col("lens"), lambda n: n <= 10).alias("short"), share(F.col("paras"), lambda n: n <= 8).alias("short_para"), ratio(total(F.col("lens")), F.size("sents")).alias("avg"),
        *[per_thousand(count(c, L.PUNCTUATION[k])).alias(v) for k, v in (("exclamation", "excl"), ("question", "ques"), ("ellipsis", "ell"), ("dash", "dash"))], per_thousand(simile_count("sents")).alias("simile"),
        ratio(quoted_chars(c), F.col("total_chars")).alias("quoted"), F.size(F.regexp_extract_all("clean", F.lit(L.QUOTE), F.lit(0))).alias("quotes"),
        *[_equal("kinds", i).alias(v) for i, v in ((1, "action"), (2, "mental"), (3, "scenery"))],
        F.when(F.size("words") > 0, F.size(F.array_distinct("words")) / F.size("words").cast("double")).alias("ttr"), some(L.POSITIVE).alias("pos"), some(L.NEGATIVE).alias("neg"),
    )
    desc = F.col("action") + F.col("mental") + F.col("scenery")
    pct = lambda k: F.when(desc > 0, F.col(k) * F.lit(100.0) / desc.cast("double"))
    polar = F.col("pos") + F.col("neg")
    return base.select(
        "*", pct("action").alias("act"), pct("mental").alias("mind"), pct("scenery").alias("env"), ratio(F.col("action"), F.col("mental")).alias("act_per_mind"),
        F.when(polar > 0, (F.col("pos") - F.col("neg")) / polar.cast("double")).otherwise(0.0).alias("balance"), (F.col("quoted") / F.greatest(F.lit(1e-6), 1 - F.col("quoted"))).alias("told"),
    )


def style_markers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The first five of seven threshold markers of a text, or ``ordinary``."""
    c = F.col
    rules = [("short_sentences", c("short") >= 30), ("dialogue", c("quoted") >= 0.3), ("similes", c("simile") >= 2), ("dashes", c("dash") >= 1.5), ("ellipses", c("ell") >= 1.5), ("long_sentences", c("avg") >= 28), ("action", c("act_per_mind") >= 2.5)]
    hit = F.slice(F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules]), lambda x: x.isNotNull()), 1, 5)
    return measures(df, keys, text).select(*keys, F.when(F.size(hit) > 0, F.array_join(hit, ",")).otherwise("ordinary").alias("markers"))


def signal_rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("X1", (c("short") > 30) & (c("excl") > 5)), ("X2", (c("short") > 30) & (c("excl") < 2)), ("X3", (c("short_para") > 20) & (c("quotes") > 0)), ("X4", (c("ttr") > 0.5) & (c("simile") > 3)),
        ("X6", (c("mind") > 30) & (c("excl") < 3)), ("X7", (c("act") > 50) & (c("short") > 25)), ("X8", (c("env") > 25) & (c("avg") > 30)),
    ]


def label_rules() -> list[tuple[str, Column, Column]]:
    """Label, gate, score."""
    c, excl, short, ques = F.col, F.col("excl"), F.col("short"), F.col("ques")
    return [
        ("轻松搞笑型", (short > 35) & (excl > 5), short * 0.3 + excl * 2), ("冷静快节奏型", (short > 30) & (excl < 2), short * 0.3 + (2 - excl) * 3), ("推理驱动型", (ques > 5) & (excl < ques * 0.5), ques * 2 + (ques - excl) * 0.5),
        ("对话驱动型", (short > 25) & (c("told") > 0.8), short * 0.2 + c("told") * 10), ("动作快节奏型", (c("act") > 60) & (short > 20), c("act") * 0.3 + short * 0.2), ("内省克制型", (c("mind") > 35) & (excl < 3), c("mind") * 0.3 + (3 - excl) * 2),
        ("铺陈留白型", (c("avg") > 35) & (c("ell") > 2), c("avg") * 0.2 + c("ell") * 2), ("热血爆发型", (excl > 8) & (short > 25), excl * 2 + short * 0.2), ("暗黑深沉型", (c("balance") < -0.3) & (c("mind") > 25), F.abs("balance") * 10 + c("mind") * 0.2),
        ("极简利落型", (c("avg") < 20) & (short > 35), (20 - c("avg")) * 0.5 + short * 0.3), ("克制写实型", (c("ell") < 0.3) & (excl < 2), (0.3 - c("ell")) * 10 + (2 - excl) * 2), ("热血爽文型", (excl > 5) & (c("balance") > 0.2), excl * 1.5 + c("balance") * 10),
        ("悬疑动作型", (ques > 3) & (c("act") > 50), ques * 2 + c("act") * 0.1),
    ]


#: Labels that read the balance of feeling, and the signal that reads the vocabulary: never given in strict mode, where these are unmeasured.
LOOSE_LABELS, LOOSE_SIGNALS = {"暗黑深沉型", "热血爽文型"}, {"X4"}


def style_signals(df: DataFrame, keys: list[str], text: str, strict: bool = False) -> DataFrame:
    """(keys, signal): cross-measure signals, one row each.  X5 needs a share of function words, which nothing measures."""
    rules = [(n, p) for n, p in signal_rules() if not (strict and n in LOOSE_SIGNALS)]
    return measures(df, keys, text).select(*keys, F.explode(F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())).alias("signal"))


def scored_labels(df: DataFrame, keys: list[str], text: str, strict: bool = False, most: int = 5) -> DataFrame:
    """(keys, rank, label, score): labels whose gate holds and whose score is positive, best first; else one fallback of score 0."""
    rules = [r for r in label_rules() if not (strict and r[0] in LOOSE_LABELS)]
    found = F.filter(F.array(*[F.when(gate & (score > 0), F.struct((-score).alias("s"), F.lit(n).alias("label"))) for n, gate, score in rules]), lambda x: x.isNotNull())
    spare = F.when(F.col("short") > 25, "快节奏叙事型").when(F.col("avg") > 30, "沉稳铺陈型").otherwise("均衡叙事型")
    given = measures(df, keys, text).select(*keys, F.slice(F.array_sort(found), 1, most).alias("f"), F.array(F.struct(F.lit(0.0).alias("s"), spare.alias("label"))).alias("g"))
    return given.select(*keys, F.posexplode(F.when(F.size("f") > 0, F.col("f")).otherwise(F.col("g"))).alias("i", "x")).select(*keys, (F.col("i") + 1).alias("rank"), "x.label", (0.0 - F.col("x.s")).alias("score"))


def style_labels(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, signals, labels, temperature): the signals and labels told from sentences, marks and descriptions alone, in
    order of their rules, and the sampling temperature that short sentences and exclamations imply."""
    some = lambda pairs: F.array_join(F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in pairs]), lambda x: x.isNotNull()), ",")
    signals = [(n, p) for n, p in signal_rules() if n not in ("X3", "X4")]
    gates = [(n, g) for n, g, _ in label_rules() if n not in LOOSE_LABELS | {"对话驱动型"}]
    order = ["轻松搞笑型", "冷静快节奏型", "推理驱动型", "动作快节奏型", "内省克制型", "铺陈留白型", "热血爆发型", "极简利落型", "克制写实型", "悬疑动作型"]
    short = F.col("short")
    warm = F.when(short > 25, F.lit(0.85) + F.least(F.lit(0.10), (short - 25) * 0.004)).when(short >= 15, F.lit(0.75) + (short - 15) * 0.01).otherwise(F.lit(0.7) + short * 0.005)
    warm = F.least(F.lit(0.95), F.greatest(F.lit(0.65), warm))
    return measures(df, keys, text).select(*keys, some(signals).alias("signals"), some(sorted(gates, key=lambda x: order.index(x[0]))).alias("labels"), F.when(F.col("excl") > 8, F.least(F.lit(0.95), warm + 0.05)).otherwise(warm).alias("temperature"))


def deployment(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, max_tokens): the answer length, in three tiers by dialogue against narration and the number of quotations."""
    told, n = F.col("told"), F.col("quotes")
    return measures(df, keys, text).select(*keys, F.when((told > 1.2) | (n > 3000), 8192).when((told > 0.8) | (n > 1000), 6144).otherwise(4096).alias("max_tokens"))


def low_level_ratios(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Readability indices with their terms of complex words (four characters or more), vocabulary, clause and length ratios, over fallback tokens."""
    runs = F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    tails = F.transform(F.filter(runs, lambda r: F.length(r) % 2 == 1), lambda r: F.right(r, F.lit(1)))
    base = prepared(df, keys, text).select(*keys, "clean", "total_chars", pairs.alias("pairs"), tails.alias("tails"), pieces(F.col("clean"), L.LOW_SENTENCE).alias("s"))
    clauses = F.transform("s", lambda x: F.greatest(F.size(pieces(x, L.CLAUSE)), F.lit(1)).cast("long"))
    base = base.select(
        *keys, "total_chars", "pairs", F.concat("pairs", "tails").alias("words"), F.size("s").cast("long").alias("n"), total(clauses).alias("clauses"),
        total(F.transform("s", lambda x: count(x, L.SUBORDINATE))).alias("subordinate"), total(F.transform("s", lambda x: count(x, L.COORDINATE))).alias("coordinate"),
    )
    size = lambda a: F.size(a).cast("long")
    long_ = size(F.filter("words", lambda w: F.length(w) >= 4))
    of_length = lambda k: ratio(size(F.filter("words", lambda w: F.length(w) == k)), size("words"))
    out = base.select("*", long_.alias("complex_words"), ratio(long_, size("words")).alias("complex_ratio"), ratio(F.col("clauses"), F.col("n")).alias("clauses_per_sentence"))
    a = F.col("clauses_per_sentence")
    return out.select(
        *keys, "complex_words", "complex_ratio", (F.lit(1.043) * F.sqrt(F.col("complex_words") / F.greatest(F.col("n"), F.lit(1)).cast("double")) + F.lit(3.1291)).alias("smog_index"),
        (F.lit(0.4) * (ratio(F.col("total_chars"), F.col("n")) + 100 * F.col("complex_ratio"))).alias("yang_index"), (F.lit(0.4) * (ratio(size("words"), F.col("n")) + 100 * F.col("complex_ratio"))).alias("fog_index"),
        ratio(size(F.array_distinct("words")), size("words")).alias("ttr"), ratio(size(F.array_distinct("pairs")), size("pairs")).alias("ttr_filtered"),
        "clauses_per_sentence", ratio(F.col("subordinate"), F.col("clauses")).alias("subordinate_ratio"), ratio(F.col("coordinate"), F.col("clauses")).alias("coordinate_ratio"),
        F.when(F.col("n") == 0, "none").when(a < 1.5, "simple").when(a < 2.5, "light").when(a < 3.5, "compound").otherwise("complex").alias("clause_level"),
        of_length(1).alias("len_1"), of_length(2).alias("len_2"), of_length(3).alias("len_3"), ratio(long_, size("words")).alias("len_4plus"),
    )


def taboo_phrases(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, phrase, n): the phrases of stock prose a text holds, and how often."""
    counted = F.array(*[F.struct(F.lit(p).alias("phrase"), count_word(F.col("clean"), p).alias("n")) for p in L.TABOO])
    return prepared(df, keys, text).select(*keys, F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("x")).select(*keys, "x.phrase", "x.n")


def special_systems(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, word): the keywords of game-like systems a text holds."""
    return prepared(df, keys, text).select(*keys, F.explode(F.filter(F.array(*map(F.lit, L.SYSTEM_WORDS)), lambda w: F.contains(F.col("clean"), w))).alias("word"))


def tagged_tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, word, flag) without a dictionary: every Han run of two or more as one noun, then every Han character untagged."""
    runs = F.transform(F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0)), lambda r: F.struct(r.alias("word"), F.lit("n").alias("flag")))
    chars = F.transform(F.regexp_extract_all("clean", F.lit(L.CJK), F.lit(0)), lambda r: F.struct(r.alias("word"), F.lit("").alias("flag")))
    return prepared(df, keys, text).select(*keys, F.posexplode(F.concat(runs, chars)).alias("i", "x")).select(*keys, (F.col("i") + 1).alias("pos"), "x.word", "x.flag")


def with_flag(tokens: DataFrame, prefix: str) -> DataFrame:
    """The tokens whose tag begins with ``prefix``."""
    return tokens.where(F.col("flag").startswith(prefix))


def pos_shares(tokens: DataFrame, key: str) -> DataFrame:
    """Shares of nouns, verbs, adjectives and adverbs among these four, and of all four among the tokens."""
    f = F.coalesce(F.col("flag"), F.lit(""))
    named = f.rlike("^n[rstz]")
    kinds = {"noun": f.startswith("n") & ~named, "verb": f.startswith("v"), "adjective": f.startswith("a"), "adverb": f.startswith("d")}
    counts = tokens.where(F.length(F.trim("word")) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    content = sum((F.col(k) for k in kinds), F.lit(0).cast("long"))
    return counts.select(key, *[ratio(F.col(k), content).alias(f"{k}_ratio") for k in kinds], ratio(content, F.col("tokens")).alias("content_ratio"), content.alias("content_words"))


ENTITIES = {"person": "nr", "place": "ns", "org": "nt", "other": "nz"}


def entities(tokens: DataFrame, key: str) -> DataFrame:
    """Counts of names of persons, places, bodies and other names, and their density."""
    f = F.coalesce(F.col("flag"), F.lit(""))
    counts = tokens.where(F.length(F.trim("word")) > 0).groupBy(key).agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(f.startswith(p)).alias(k) for k, p in ENTITIES.items()])
    all_ = sum((F.col(k) for k in ENTITIES), F.lit(0).cast("long"))
    return counts.select(key, *ENTITIES, all_.alias("entities"), ratio(all_, F.col("tokens")).alias("density"))


def entity_samples(tokens: DataFrame, key: str, most: int = 10) -> DataFrame:
    """(key, kind, rank, word): the first different names of each kind."""
    f = F.col("flag")
    kind = F.when(f.startswith("nr"), "person").when(f.startswith("ns"), "place").when(f.startswith("nt"), "org").when(f.startswith("nz"), "other")
    first = tokens.withColumn("kind", kind).where("kind is not null and trim(word) <> ''").groupBy(key, "kind", "word").agg(F.min("pos").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key, "kind").orderBy("first"))).where(F.col("rank") <= most).select(key, "kind", "rank", "word")


def worldview(tokens: DataFrame, key: str, least: int = 5, most: int = 10) -> DataFrame:
    """(key, category, rank, word, n): words of two characters or more seen more than ``least`` times, by the tag of their first occurrence.

    Other names fill three categories one after the other, ``most`` words each.
    """
    w = F.trim("word")
    counts = tokens.select(key, w.alias("word"), "pos", F.coalesce("flag", F.lit("")).alias("flag")).where(F.length("word") >= 2).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min_by("flag", "pos").alias("flag")).where(F.col("n") > least)
    counts = counts.withColumn("tag", F.substring("flag", 1, 2)).where(F.col("tag").isin("nr", "nz", "ns"))
    counts = counts.withColumn("r", F.row_number().over(Window.partitionBy(key, "tag").orderBy(F.desc("n"), "word")) - 1).withColumn("b", F.floor(F.col("r") / most))
    category = F.when((F.col("tag") == "nr") & (F.col("b") == 0), "核心角色").when((F.col("tag") == "ns") & (F.col("b") == 0), "地域场景").when(F.col("tag") == "nz", F.try_element_at(F.array(*map(F.lit, ["核心设定", "力量体系", "组织势力"])), (F.col("b") + 1).cast("int")))
    return counts.withColumn("category", category).where("category is not null").select(key, "category", (F.col("r") % most + 1).cast("int").alias("rank"), "word", "n")
