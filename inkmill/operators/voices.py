"""Voices (D11, D13-D19, D21, D22): habits of speakers, top lists, tags, functions of speech, exemplars.

Ranks are by count, ties by first occurrence in the text.  Texts without quotations have no rows, but for
``semantic_dimensions``, which has one row per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import computed, latest_texts, materialise
from inkmill.functions.text import count_chars, count_words
from inkmill.operators.dialogue import function_of, normal_name, plausible, quotes
from inkmill.operators.noise import with_clean
from inkmill.operators.structure import interval_join
from inkmill.operators.style import ratio


def said(df: DataFrame, key: str, text: str) -> DataFrame:
    """Quotations of named speakers: key, q_no, content, block, tag, speaker."""
    return spoken(quotes(df, key, text), key)


def spoken(found: DataFrame, key: str) -> DataFrame:
    return computed(found.where("name is not null"), [key, "q_no", "content", "block", "tag"], speaker=normal_name(F.col("name"))).where(plausible(F.col("speaker")))


def aliases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, speaker, name, n): the spellings that were put together as one speaker, where there are several."""
    q = computed(quotes(df, key, text).where("name is not null"), [key, "name"], speaker=normal_name(F.col("name"))).where(plausible(F.col("speaker")))
    counts = q.groupBy(key, "speaker", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(key, "speaker"))).where("k > 1").drop("k")


def quote_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(work_id, chunk_id, q_no, chapter_id) of every quotation: the chapter that holds its place, before the first and behind the last the nearest."""
    texts = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos", "chunk_text"]).withColumn("k", F.struct("work_id", "chunk_id", "start_pos"))
    q = quotes(texts, "k", "chunk_text").select("k.work_id", "k.chunk_id", "q_no", (F.col("k.start_pos") + F.col("pos")).alias("at"))
    ends = chapters.groupBy("work_id").agg(F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"))
    q = q.join(ends, "work_id").withColumn("at", F.greatest("lo", F.least(F.col("at"), F.col("hi") - 1)))
    spans = chapters.select("work_id", "chapter_id", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    return interval_join(q, spans, "work_id", "at", "s", "e").groupBy("work_id", "chunk_id", "q_no").agg(F.min("chapter_id").alias("chapter_id"))


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fixed_phrases(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, speaker, rank, word, n): pairs of characters a speaker repeats: of the 30 most frequent the first 10 with at
    least max(2, lines // 10) occurrences."""
    q = said(df, key, text).withColumn("lines", F.count(F.lit(1)).over(Window.partitionBy(key, "speaker")))
    runs = q.select(key, "speaker", "lines", "q_no", F.posexplode(F.regexp_extract_all("content", F.lit(L.CJK + "{2,}"), F.lit(0))).alias("r", "run"))
    pairs = runs.select(key, "speaker", "lines", "q_no", "r", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring(F.col("run"), i, F.lit(2)))).alias("i", "word"))
    counts = pairs.groupBy(key, "speaker", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("q_no", "r", "i")).alias("first"), F.max("lines").alias("lines"))
    top = ranked(counts, [key, "speaker"], F.desc("n"), F.col("first"))
    return top.where("n >= greatest(2, floor(lines / 10)) and rank <= 10").select(key, "speaker", "rank", "word", "n")


def opening_words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, speaker, rank, word, n): first pairs of lines among the speaker's 10 most frequent, in at least max(2, lines // 15)."""
    q = said(df, key, text).withColumn("word", F.regexp_extract("content", L.CJK + "{2}", 0))
    lines = F.count(F.lit(1)).over(Window.partitionBy(key, "speaker"))
    counts = q.withColumn("lines", lines).where("word <> ''").groupBy(key, "speaker", "word").agg(F.count(F.lit(1)).alias("n"), F.min("q_no").alias("first"), F.max("lines").alias("lines"))
    return ranked(counts, [key, "speaker"], F.desc("n"), F.col("first")).where("rank <= 10 and n >= greatest(2, floor(lines / 15))").select(key, "speaker", "rank", "word", "n")


def speaker_tags(q: DataFrame, key: str) -> DataFrame:
    """(key, speaker, tag, n, rank) of each speaker's three favourite tags."""
    counts = q.groupBy(key, "speaker", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("q_no").alias("first"))
    return ranked(counts, [key, "speaker"], F.desc("n"), F.col("first")).where("rank <= 3").drop("first")


def common_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    return speaker_tags(said(df, key, text), key)


def sample_quotes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, speaker, rank, quote): the first three lines of each speaker, cut at 50 characters as in the reports."""
    q = ranked(said(df, key, text), [key, "speaker"], F.col("q_no")).where("rank <= 3")
    return q.select(key, "speaker", "rank", F.substring("content", 1, 50).alias("quote"))


def profiles(q: DataFrame, key: str) -> DataFrame:
    out = q.groupBy(key, "speaker").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("block").alias("blocks"), F.min("q_no").alias("first"))
    return out.withColumn("confidence", F.when((F.col("lines") >= 3) & (F.col("blocks") >= 2), "high").otherwise("low"))


def speaker_lists(df: DataFrame, key: str, text: str, high: int = 10, low: int = 20) -> DataFrame:
    """(key, confidence, rank, speaker, lines): the most talkative speakers of high and of low confidence."""
    out = ranked(profiles(said(df, key, text), key), [key, "confidence"], F.desc("lines"), F.col("first"))
    return out.where(F.col("rank") <= F.when(F.col("confidence") == "high", high).otherwise(low)).select(key, "confidence", "rank", "speaker", "lines")


def tag_frequencies(df: DataFrame, key: str, text: str, most: int = 15) -> DataFrame:
    """(key, rank, tag, n): the most frequent tags of each text, with or without a speaker."""
    counts = quotes(df, key, text).where("tag is not null").groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"), F.min("q_no").alias("first"))
    return ranked(counts, [key], F.desc("n"), F.col("first")).where(F.col("rank") <= most).select(key, "rank", "tag", "n")


def tag_ratio(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dao, shuo, dao_per_shuo): tags of the two families, by their last character."""
    q = quotes(df, key, text).where("tag is not null")
    out = q.groupBy(key).agg(F.count_if(F.col("tag").endswith("道")).alias("dao"), F.count_if(F.col("tag").endswith("说")).alias("shuo"))
    return out.select("*", ratio(F.col("dao"), F.col("shuo")).alias("dao_per_shuo"))


def unique_tags(df: DataFrame, key: str, text: str, most: int = 10) -> DataFrame:
    """(key, rank, tag, speaker, n): favourite tags that exactly one speaker of high confidence has; n counts the whole text."""
    every = materialise(quotes(df, key, text).where("tag is not null or name is not null").drop("pos"))
    q = spoken(every, key)
    sure = profiles(q, key).where("confidence = 'high'").select(key, "speaker")
    owned = speaker_tags(q, key).join(sure, [key, "speaker"]).groupBy(key, "tag").agg(F.count(F.lit(1)).alias("owners"), F.min("speaker").alias("speaker")).where("owners = 1")
    counts = every.where("tag is not null").groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))
    return ranked(owned.join(counts, [key, "tag"]), [key], F.desc("n"), F.col("tag")).where(F.col("rank") <= most).select(key, "rank", "tag", "speaker", "n")


def function_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, function, n, share) of the quotations of each text."""
    counts = quotes(df, key, text).groupBy(key, function_of(F.col("content")).alias("function")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def semantic_dimensions(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: quotations by function, markers of person, leading person and its stability."""
    labels = [label for label, _ in L.FUNCTIONS]
    per = quotes(df, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("n_quotes"), *[F.count_if(function_of(F.col("content")) == x).alias(f"f{i}") for i, x in enumerate(labels)])
    clean = with_clean(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    c = F.col("clean")
    base = clean.select(key, count_chars(c, "我咱俺").alias("first_markers"), (count_chars(c, "他她它") + count_words(c, ["他们", "她们"])).alias("third_markers"))
    out = base.join(per, key, "left").fillna(0, ["n_quotes", *[f"f{i}" for i in range(len(labels))]])
    a, b = F.col("first_markers"), F.col("third_markers")
    lead = F.when(a + b == 0, "none").when(a * 10 > (a + b) * 6, "first").when(a * 10 < (a + b) * 4, "third").otherwise("mixed")
    stable = F.when(a + b == 0, "none").when(4 * F.greatest(a, b) > 3 * (a + b), "stable").otherwise("shifting")
    return out.select("*", lead.alias("person"), stable.alias("stability"))


def exemplars(df: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """(key, kind, rank, content): the first quotations of each text that are fit (6 to 60 characters) or overdone."""
    c = F.col("content")
    heaped = F.size(F.filter(F.array(*map(F.lit, L.DECORATIVE)), lambda t: F.contains(c, t)))
    bad = (heaped >= 2) | (count_chars(c, "…") >= 3) | (count_chars(c, "！") >= 3)
    rows = quotes(df, key, text).withColumn("kind", F.when(bad, "overdone").when(F.length("content").between(6, 60), "fit")).where("kind is not null")
    return ranked(rows, [key, "kind"], F.col("q_no")).where(F.col("rank") <= most).select(key, "kind", "rank", "content")
