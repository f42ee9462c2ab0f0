"""Structure of books (C1-C5, P1-P10, E1-E3): headings, chapter spans, interval and as-of joins, reading plan, chunk folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import latest, latest_texts
from inkmill.functions.text import strip, total
from inkmill.operators.noise import lines


def heading_lines(chunks: DataFrame) -> DataFrame:
    """(work_id, pos, title) of heading lines; pos is 0-based on the axis of start_pos.  Chunks delivered again count once."""
    return found_lines(latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos", "chunk_text"]), L.HEADING)


def found_lines(once: DataFrame, pattern: str) -> DataFrame:
    """(work_id, pos, title) of the lines that match a pattern."""
    found = once.select("work_id", "start_pos", lines(F.col("chunk_text")).alias("l"))
    heads = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("i"), strip(x).alias("title"))), lambda h: h["title"].rlike(pattern))
    at = lambda h: F.struct((F.col("start_pos") + total(F.transform(F.slice("l", F.lit(1), h["i"]), lambda x: F.length(x).cast("long")))).alias("pos"), h["title"].alias("title"))
    return found.select("work_id", F.explode(F.transform(heads, at)).alias("h")).select("work_id", "h.pos", "h.title").distinct()


def chapter_index(chunks: DataFrame) -> DataFrame:
    """Half-open chapter spans of works with at least two headings; text before the first heading belongs to none."""
    heads = heading_lines(chunks)
    once = latest(chunks.select("work_id", "chunk_id", "ingested_at", (F.col("start_pos") + F.length("chunk_text")).alias("e")), ["work_id", "chunk_id"], "ingested_at", ["e"])
    ends = once.groupBy("work_id").agg(F.max("e").alias("work_end"))
    w = Window.partitionBy("work_id").orderBy("pos")
    out = heads.groupBy("work_id", "pos").agg(F.min("title").alias("title")).withColumn("next", F.lead("pos").over(w)).withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("work_id")))
    return out.where("n >= 2").join(ends, "work_id").select("work_id", F.col("idx").cast("int").alias("chapter_idx"), "title", F.col("pos").alias("start_pos"), F.coalesce("next", "work_end").alias("end_pos"))


def chapter_volumes(chunks: DataFrame) -> DataFrame:
    """(work_id, chapter_idx, volume) of every chapter heading: the last volume heading before it, cut to ``第X卷``; null before the first."""
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos", "chunk_text"])
    heads = chapter_index(chunks).select("work_id", F.col("start_pos").alias("pos"), "chapter_idx", F.lit(None).cast("string").alias("volume"))
    volumes = found_lines(once, L.VOLUME).select("work_id", "pos", F.lit(None).cast("int").alias("chapter_idx"), F.regexp_extract("title", f"^第[{L.NUMERALS}]+卷", 0).alias("volume"))
    before = Window.partitionBy("work_id").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    return heads.unionByName(volumes).withColumn("volume", F.max_by("volume", F.when(F.col("volume").isNotNull(), F.col("pos"))).over(before)).where("chapter_idx is not null").select("work_id", "chapter_idx", "volume")


def fallback_index(df: DataFrame, key: str, text: str, size: int = 4000) -> DataFrame:
    """Equal parts of texts as chapters: (key, chapter_idx, title, start_pos, end_pos, is_fallback)."""
    parts = fallback_chapters(df, key, text, size)
    return parts.select(key, (F.col("part_no") - 1).alias("chapter_idx"), F.format_string("分段_%03d", F.col("part_no")).alias("title"), "start_pos", "end_pos", F.lit(True).alias("is_fallback"))


def interval_join(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: int = 4000) -> DataFrame:
    """Left outer join of points to the half-open spans that hold them, as an equi join on (key, bucket of ``width``).

    A hot key is spread over its buckets; a span is repeated once per bucket it touches.
    """
    a = points.withColumn("_b", F.floor(F.col(point) / width))
    b = spans.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    b = b.select(F.col(key).alias("_k"), F.col("_b").alias("_bb"), F.col(start).alias("_s"), F.col(end).alias("_e"), *[c for c in spans.columns if c not in (key, start, end)])
    return a.join(b, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_bb")) & (F.col(point) >= F.col("_s")) & (F.col(point) < F.col("_e")), "left").drop("_b", "_k", "_bb", "_s", "_e")


def chunk_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """(work_id, chunk_id, chapter_id) of every chunk; null where no chapter holds its start."""
    once = latest(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos"])
    spans = chapters.select("work_id", "chapter_id", F.col("start_pos").alias("s"), F.col("end_pos").alias("e"))
    return interval_join(once, spans, "work_id", "start_pos", "s", "e").groupBy("work_id", "chunk_id").agg(F.min("chapter_id").alias("chapter_id"))


def volume_asof(chapters: DataFrame) -> DataFrame:
    """Each chapter with the last volume named at or before it."""
    w = Window.partitionBy("work_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, 0)
    return chapters.select("work_id", "chapter_id", F.last("volume", ignorenulls=True).over(w).alias("volume"))


def fallback_chapters(df: DataFrame, key: str, text: str, size: int = 4000) -> DataFrame:
    """Equal parts of texts: (key, part_no, start_pos, end_pos); empty texts have none."""
    n = F.length(text)
    return df.where(n > 0).select(key, F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("k", "start_pos"), n.alias("n")).select(key, (F.col("k") + 1).alias("part_no"), "start_pos", F.least(F.col("start_pos") + size, "n").alias("end_pos"))


def _era(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, L.ERAS)), (i + 1).cast("int"))


def era_bounds(n: Column) -> list[tuple[Column, Column]]:
    """Half-open spans of chapter numbers of the five periods of a book of n chapters."""
    cut = [F.floor(n * s).cast("int") for s in L.ERA_SHARES]
    ends = [F.greatest(F.lit(1), cut[0]), *[F.greatest(a + 1, b) for a, b in zip(cut, cut[1:])], n.cast("int")]
    return list(zip([F.lit(0), *cut], ends))


def reading_plan(chapters: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, chapter_idx, chapter_id, era) of the chapters to read.

    A work within the budget or of at most five chapters is read whole, its chapters spread over as many periods as it
    has chapters (five at most).  Else each of five periods gives chapters from its beginning, middle or end until a
    fifth of the budget and two chapters are reached, at most half as much again.  Window sums replace the loops.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    all_ = Window.partitionBy("work_id")
    base = chapters.select("work_id", "chapter_id", F.col("chapter_idx").cast("int").alias("idx"), F.col("n_chars").cast("long").alias("len"))
    base = base.withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("chars", F.sum("len").over(all_))
    small = (F.col("chars") <= budget) | (F.col("n") <= 5)
    choice = F.array(*[F.array(*map(F.lit, L.ERA_CHOICE[k])) for k in range(1, 6)])
    k = F.least("n", F.lit(5)).cast("int")
    slot = F.least(F.floor(F.col("idx") * k / F.col("n")), k - 1).cast("int")
    whole = base.where(small).select("work_id", "idx", "chapter_id", _era(F.element_at(F.element_at(choice, k), slot + 1)).alias("era"))

    spans = F.array(*[F.struct(F.lit(i).alias("e"), a.cast("int").alias("a"), b.cast("int").alias("b")) for i, (a, b) in enumerate(era_bounds(F.col("n")))])
    large = base.where(~small).withColumn("s", F.explode(spans)).select("work_id", "idx", "chapter_id", "len", "s.*").where("idx >= a and idx < b")
    label = large.groupBy("work_id", "idx").agg(F.min("e").alias("first_e"))
    m = F.col("b") - F.col("a")
    pick = F.when(F.col("e") == 0, F.col("a")).when(F.col("e") == 4, F.greatest(F.col("a"), F.col("b") - 2)).otherwise(F.col("a") + F.floor(m / 2).cast("int"))
    large = large.withColumn("pick", pick)
    per = budget // 5
    order = Window.partitionBy("work_id", "e").orderBy("idx")
    ahead = large.where("idx >= pick").withColumn("rn", F.row_number().over(order)).withColumn("acc", F.sum("len").over(order))
    ahead = ahead.where((F.col("acc") - F.col("len") < per) | (F.col("rn") <= 2)).withColumn("got", F.count(F.lit(1)).over(Window.partitionBy("work_id", "e")))
    kept = ahead.where((F.col("acc") <= per + per // 2) | (F.col("rn") <= 2) | (F.col("e") == 4)).select("work_id", "idx", "chapter_id")
    back = large.where("idx < pick").withColumn("rn", F.row_number().over(Window.partitionBy("work_id", "e").orderBy(F.desc("idx"))))
    back = back.join(ahead.select("work_id", "e", "got").distinct(), ["work_id", "e"]).where(F.col("rn") <= 2 - F.col("got")).select("work_id", "idx", "chapter_id")
    picked = kept.unionByName(back).distinct().join(label, ["work_id", "idx"]).select("work_id", "idx", "chapter_id", _era(F.col("first_e")).alias("era"))
    return whole.unionByName(picked).select("work_id", F.col("idx").alias("chapter_idx"), "chapter_id", "era")


def plan_coverage(chapters: DataFrame) -> DataFrame:
    """(work_id, n, covered): chapters, and those that the five periods of the plan cover; equal unless the plan has a hole."""
    n = F.count(F.lit(1)).over(Window.partitionBy("work_id"))
    base = chapters.select("work_id", F.col("chapter_idx").cast("int").alias("idx"), n.alias("n"))
    spans = F.array(*[F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in era_bounds(F.col("n"))])
    held = F.exists(spans, lambda s: (F.col("idx") >= s["a"]) & (F.col("idx") < s["b"]))
    return base.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("covered"))


def planned(chapters: DataFrame, budget: int) -> DataFrame:
    own = chapters.select("work_id", "chapter_id", F.col("chapter_idx").cast("int").alias("chapter_idx"), F.col("chapter_no").alias("no"), "title", F.coalesce("volume", F.lit("")).alias("volume"), F.col("start_pos").alias("orig_start"), F.col("end_pos").alias("orig_end"))
    return reading_plan(chapters, budget).join(own.drop("chapter_id"), ["work_id", "chapter_idx"])


def chunk_eras(chunks: DataFrame, chapters: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, chunk_id, era) of every chunk: the period of the sampled chapter that holds its start, else 未分期."""
    once = latest(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos"])
    spans = planned(chapters, budget).select("work_id", "era", F.col("orig_start").alias("s"), F.col("orig_end").alias("e"))
    return interval_join(once, spans, "work_id", "start_pos", "s", "e").groupBy("work_id", "chunk_id").agg(F.coalesce(F.min("era"), F.lit(L.UNPLACED)).alias("era"))


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    """(work_id, chunk_id, offset): where chunks begin if laid end to end in the order of their ids as strings (c1000 before c999)."""
    once = latest(chunks.select("work_id", "chunk_id", "ingested_at", F.length("chunk_text").cast("long").alias("n")), ["work_id", "chunk_id"], "ingested_at", ["n"])
    w = Window.partitionBy("work_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return once.select("work_id", "chunk_id", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))


def plan_offsets(chapters: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, chapter_id, orig_start, orig_end, start_pos, end_pos): where sampled chapters stand in the sampled text, two line breaks between them."""
    w = Window.partitionBy("work_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("orig_end") - F.col("orig_start")
    out = planned(chapters, budget).withColumn("start_pos", F.coalesce(F.sum(size + 2).over(w), F.lit(0)))
    return out.select("work_id", "chapter_id", "orig_start", "orig_end", "start_pos", (F.col("start_pos") + size).alias("end_pos"))


def plan_summary(chapters: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, n_sampled, sampled_chars, coverage_pct): the size of the sampled text with its separators, and its share of the whole."""
    total_ = chapters.groupBy("work_id").agg(F.max("end_pos").alias("chars"))
    own = plan_offsets(chapters, budget).groupBy("work_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.max("end_pos").alias("sampled_chars"))
    return own.join(total_, "work_id").select("work_id", "n_sampled", "sampled_chars", (F.col("sampled_chars") * F.lit(100.0) / F.greatest("chars", F.lit(1)).cast("double")).alias("coverage_pct"))


def plan_ranges(chapters: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, era, range): first and last sampled chapter of each period in words, with the volume where there is one."""
    named = F.when(F.col("title").rlike("[章回节]"), F.regexp_extract("title", "[0-9零一二三四五六七八九十百千万〇两]+", 0)).otherwise("")
    label = F.struct("chapter_idx", F.col("volume").alias("v"), F.when(named != "", named).otherwise(F.col("no").cast("string")).alias("n"))
    ends = planned(chapters, budget).groupBy("work_id", "era").agg(F.min(label).alias("a"), F.max(label).alias("b"))
    a, b = F.col("a"), F.col("b")
    one = lambda x: F.concat(F.when(x["v"] != "", F.concat(x["v"], F.lit("·"))).otherwise(""), F.lit("第"), x["n"], F.lit("章"))
    span = F.concat(F.lit("第"), a["n"], F.lit("~"), b["n"], F.lit("章"))
    return ends.select("work_id", "era", F.when((a["v"] == "") & (b["v"] == ""), span).when(a["v"] == b["v"], F.concat(a["v"], F.lit(" "), span)).otherwise(F.concat(one(a), F.lit(" ~ "), one(b))).alias("range"))


def sampled_texts(chapters: DataFrame, chunks: DataFrame, budget: int = 150_000) -> DataFrame:
    """(work_id, sampled_text): the sampled chapters in order, two line breaks between them; a work's text is bounded by the budget.

    Chapters meet the chunks they overlap on (work, 4,000-character bucket); only the overlapping parts are gathered.
    """
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos", "chunk_text"])
    c = once.select("work_id", F.col("start_pos").alias("s"), "chunk_text").withColumn("e", F.col("s") + F.length("chunk_text"))
    spans = plan_offsets(chapters, budget).select("work_id", "chapter_id", F.col("orig_start").alias("a"), F.col("orig_end").alias("z"), "start_pos")
    bucket = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / 4000), F.floor((F.col(high) - 1) / 4000)))
    met = spans.where("z > a").withColumn("k", bucket("a", "z")).join(c.where("e > s").withColumn("k", bucket("s", "e")), ["work_id", "k"]).where("s < z and e > a").where(F.col("k") == F.floor(F.greatest("s", "a") / 4000))
    part = F.substring(F.col("chunk_text"), (F.greatest(F.col("a") - F.col("s"), F.lit(0)) + 1).cast("int"), (F.least("z", "e") - F.greatest("a", "s")).cast("int"))
    per = met.groupBy("work_id", "chapter_id", "start_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    return per.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_pos", "t"))), lambda x: x["t"]), "\n\n").alias("sampled_text"))


def fold_chunks(df: DataFrame, key: str, text: str, size: int = 2000) -> DataFrame:
    """Whole lines gathered until a chunk has ``size`` characters: (key, chunk_id, start_pos, n_chars), lossless."""
    l = lines(F.coalesce(F.col(text), F.lit("")))
    step = lambda s, n: F.when(
        s["acc"] + n >= size, F.struct(F.concat(s["done"], F.array(s["acc"] + n)).alias("done"), F.lit(0).cast("long").alias("acc"))
    ).otherwise(F.struct(s["done"].alias("done"), (s["acc"] + n).alias("acc")))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("long").alias("acc"))
    folded = F.aggregate(F.transform(l, lambda x: F.length(x).cast("long")), start, step, lambda s: F.when(s["acc"] > 0, F.concat(s["done"], F.array(s["acc"]))).otherwise(s["done"]))
    out = df.select(key, folded.alias("n")).select(key, "n", F.posexplode("n").alias("i", "n_chars"))
    return out.select(key, F.format_string("c%03d", F.col("i") + 1).alias("chunk_id"), total(F.slice("n", F.lit(1), F.col("i"))).alias("start_pos"), "n_chars")
