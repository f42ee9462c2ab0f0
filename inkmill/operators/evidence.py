"""Evidence (E4-E7, E9, E10) and identity (V1 for author and title, V2, V3, V7, V8): anchors, the candidate pool, quote verification, leak scan and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import computed, latest, latest_texts, materialise
from inkmill.functions.probes import find_quotes
from inkmill.functions.text import strip
from inkmill.operators.noise import lines
from inkmill.operators.style import is_simile

TYPES = ["metaphor", "dash", "ellipsis", "tag", "short_para", "example"]


def garbled(s: Column) -> Column:
    return ~s.rlike(L.DIALOGUE_LINE) & (F.length(s) > 12) & ~s.rlike(L.FUNCTION_WORD)


def anchors(chunks: DataFrame, places: bool = False) -> DataFrame:
    """(work_id, chunk_id, era, k, type, quote): the first anchor of each type per chunk; a garbled first hit ends the search,
    but for metaphors, which go on to the next.  With ``places`` also where the quote begins on the axis of the work."""
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text", "era", "start_pos"])
    trim = "^[，、；：]+|[，、；：]+$"
    # each list once: sentences and lines, and of these only the lengths that an anchor can have
    cut = F.filter(F.transform(F.split("chunk_text", L.SENTENCE, -1), lambda s: strip(s)), lambda s: F.length(s) >= 8)
    keep = ["work_id", "chunk_id", "era", "start_pos", *(["chunk_text"] if places else [])]
    once = computed(once, [*keep], sents=F.transform(cut, lambda s: F.regexp_replace(s, trim, "")), rows=F.filter(F.transform(lines(F.col("chunk_text")), lambda s: strip(s)), lambda s: F.length(s) <= 80))
    sents, rows = F.col("sents"), F.col("rows")
    short = F.transform(F.filter(rows, lambda s: s.rlike("[。！？][，、；： ]*$")), lambda s: F.regexp_replace(s, "^[，、；： ]+|[，、；： ]+$", ""))
    some = lambda a, f: F.try_element_at(F.filter(a, f), F.lit(1))
    fits = lambda s: F.length(s).between(8, 60)
    broken = "……[^…\\n]"
    picks = {
        "metaphor": some(sents, lambda s: F.length(s).between(8, 80) & is_simile(s) & ~garbled(s)),
        "dash": some(sents, lambda s: fits(s) & F.contains(s, F.lit("——")) & ~s.rlike(broken)),
        "ellipsis": some(sents, lambda s: fits(s) & s.rlike(broken)),
        "tag": some(rows, lambda s: (F.length(s) <= 80) & (s.rlike(L.TAG_FRONT) | s.rlike(L.TAG_REAR))),
        "short_para": some(short, lambda s: F.length(s).between(2, 8) & s.rlike("[。！？]$")),
        "example": some(sents, lambda s: fits(s) & s.rlike(L.EXAMPLE)),
    }
    picked = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("type"), q.alias("quote")) for i, (t, q) in enumerate(picks.items())])
    if places:
        picked = F.transform(picked, lambda a: F.struct(a["k"].alias("k"), a["type"].alias("type"), a["quote"].alias("quote"), (F.col("start_pos") + F.instr(F.col("chunk_text"), a["quote"]) - 1).alias("at")))
    out = once.select("work_id", "chunk_id", "era", F.explode(picked).alias("a"))
    out = out.select("work_id", "chunk_id", "era", "a.k", "a.type", "a.quote", *([F.col("a.at").alias("start_pos")] if places else [])).where("quote is not null")
    return out.where(F.col("type").isin("metaphor", "short_para") | ~garbled(F.col("quote")))


def evidence_pool(chunks: DataFrame, most: int = 28, places: bool = False) -> DataFrame:
    """Candidates drawn in rounds over the periods of a work, one chunk per period and round, each period within its share.

    Both limits are prefixes of one order (round, period, candidate), so two ranks replace the loop.  Only the first
    ``most`` candidates of a period can be drawn; they are picked in hashed parts of the period first, so a hot work is
    not sorted in one task, and only chunks up to the last of them are numbered.
    """
    found = materialise(anchors(chunks, places))
    w = Window.partitionBy("work_id", "chunk_id").orderBy("k")
    code = F.aggregate(F.split("chunk_id", ""), F.lit(0), lambda s, c: s + F.ascii(c))
    n = F.count(F.lit(1)).over(Window.partitionBy("work_id", "chunk_id"))
    found = found.withColumn("i", F.row_number().over(w) - 1).withColumn("m", n).withColumn("turn", F.pmod(F.col("i") - F.pmod(code, F.col("m")), F.col("m"))).where(F.length("quote") >= 6)
    part = found.withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(64)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("work_id", "era", "part").orderBy("chunk_id", "turn"))).where(F.col("r") <= most)
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("work_id", "era").orderBy("chunk_id", "turn"))).where(F.col("r") <= most).drop("part", "r")
    once = latest(chunks, ["work_id", "chunk_id"], "ingested_at", ["era"])
    bounds = first.groupBy("work_id", F.col("era").alias("e")).agg(F.max("chunk_id").alias("upto"))
    near = once.join(bounds, (once["work_id"] == bounds["work_id"]) & once["era"].eqNullSafe(bounds["e"]) & (once["chunk_id"] <= bounds["upto"])).select(once["work_id"], "chunk_id", "era")
    rounds = near.select("work_id", "chunk_id", F.row_number().over(Window.partitionBy("work_id", "era").orderBy("chunk_id")).alias("round"))
    eras = once.groupBy("work_id").agg(F.countDistinct("era").alias("eras"))
    drawn = first.where("era is not null").join(rounds, ["work_id", "chunk_id"]).join(eras, "work_id")
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("work_id", "era").orderBy("round", "turn"))).where(F.col("r") <= F.ceil(F.lit(most) / F.col("eras")))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy("round", "era", "turn"))).where(F.col("rank") <= most)
    return drawn.select("work_id", F.format_string("E%04d", F.col("rank")).alias("evidence_id"), "chunk_id", "era", "type", "quote", *(["start_pos"] if places else []))


def normal(c: Column) -> Column:
    """White space deleted, quotes, dashes and ellipses folded."""
    return F.replace(F.translate(F.regexp_replace(c, f"[{L.WS}]+", ""), "“”‘’—", "\"\"''-"), F.lit("…"), F.lit("..."))


def verify(items: DataFrame, chunks: DataFrame, least: int = 6) -> DataFrame:
    """(item_id, status, chunk_id): valid in the cited chunk, fixed to the first chunk of the work that holds it, else downgraded.

    Quotes meet their cited chunk by key.  Those it does not hold are sought in all chunks of their work by one scan
    (``find_quotes``), which emits finds only: quotes are never paired with chunks that do not hold them.
    """
    texts = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["seq", "chunk_text"]).select("work_id", "chunk_id", "seq", normal(F.col("chunk_text")).alias("t"))
    cites = latest(items, ["item_id"], "ingested_at", ["work_id", "chunk_id", "quote"]).select("item_id", "work_id", F.lower(F.trim("chunk_id")).alias("cited"), F.coalesce(normal(F.col("quote")), F.lit("")).alias("q"))
    long_ = cites.where(F.length("q") >= least)
    met = long_.where("cited <> ''").join(texts.select("work_id", F.col("chunk_id").alias("cited"), "t"), ["work_id", "cited"]).where(F.contains("t", "q"))
    valid = materialise(met.select("item_id", F.lit("valid").alias("status"), F.col("cited").alias("chunk_id")))
    open_ = long_.join(valid.select("item_id"), "item_id", "left_anti").select("item_id", "work_id", "q", F.xxhash64("work_id", "q").alias("quote_key"))
    found = find_quotes(texts, ["work_id", "chunk_id", "seq"], "work_id", "t", open_.select(F.col("work_id").alias("g"), "q", "quote_key"))
    first = found.groupBy("work_id", "quote_key").agg(F.min(F.struct("seq", "chunk_id")).alias("f")).select("work_id", "quote_key", F.col("f.chunk_id").alias("chunk_id"))
    fixed = open_.join(first, ["work_id", "quote_key"]).select("item_id", F.lit("fixed").alias("status"), "chunk_id")
    return cites.select("item_id").join(valid.unionByName(fixed), "item_id", "left").select("item_id", F.coalesce("status", F.lit("downgraded")).alias("status"), "chunk_id")


def work_codes(works: DataFrame) -> DataFrame:
    """A stable code of author and title that reveals neither."""
    seed = F.regexp_replace(F.concat(F.coalesce("author_name", F.lit("")), F.lit("|"), F.coalesce("title", F.lit(""))), r"^\|+|\|+$", "")
    return works.select("work_id", F.when(seed == "", "WORK_UNKNOWN").otherwise(F.concat(F.lit("WORK_"), F.upper(F.substring(F.sha2(seed, 256), 1, 6)))).alias("code"))


def terms(works: DataFrame) -> DataFrame:
    """(work_id, kind, term): what must not leak."""
    return works.select("work_id", F.explode(F.array(F.struct(F.lit("author").alias("kind"), strip(F.col("author_name")).alias("term")), F.struct(F.lit("title").alias("kind"), strip(F.col("title")).alias("term")))).alias("x")).select("work_id", "x.kind", "x.term").where(F.length("term") >= 2)


def whole_word(term: Column) -> Column:
    """A pattern for a term of ASCII characters that stands as a word of its own; null for other terms."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(term.rlike(r"^[\x00-\x7f]+$"), F.concat(F.lit("(?<![A-Za-z0-9_])"), quoted, F.lit("(?![A-Za-z0-9_])")))


def leak_scan(works: DataFrame, chunks: DataFrame) -> DataFrame:
    """(work_id, chunk_id, kind, hits): author and title names inside a work's own text; ASCII names only as whole words."""
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text"])
    both = once.join(terms(works), "work_id").where(F.contains("chunk_text", "term"))
    anywhere = F.floor((F.length("chunk_text") - F.length(F.replace("chunk_text", "term", F.lit("")))) / F.length("term"))
    word = whole_word(F.col("term"))
    hits = F.when(word.isNotNull(), F.regexp_count("chunk_text", word).cast("long")).otherwise(anywhere)
    return both.select("work_id", "chunk_id", "kind", hits.alias("hits")).where("hits > 0")


def masked(works: DataFrame, chunks: DataFrame, author: str = "某作者", title: str = "某书") -> DataFrame:
    """(work_id, chunk_id, masked): texts with author and title replaced by labels, longest term first, ASCII names only as whole words.

    The text is cut at the longer term, the shorter one is replaced in the parts, and these are joined by the longer
    one's label, so no label is replaced again whatever characters the text holds.
    """
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text"])
    names = terms(works).groupBy("work_id").agg(F.max(F.when(F.col("kind") == "author", F.col("term"))).alias("author"), F.max(F.when(F.col("kind") == "title", F.col("term"))).alias("title"))
    both = once.join(names, "work_id", "left")
    a, t, x = F.col("author"), F.col("title"), F.col("chunk_text")
    first = F.length(F.coalesce(t, F.lit(""))) >= F.length(F.coalesce(a, F.lit("")))
    both = both.select("work_id", "chunk_id", "chunk_text", F.when(first, t).otherwise(a).alias("long"), F.when(first, a).otherwise(t).alias("short"), F.when(first, title).otherwise(author).alias("long_label"), F.when(first, author).otherwise(title).alias("short_label"))
    pattern = lambda c: F.coalesce(whole_word(F.col(c)), F.concat(F.lit(r"\Q"), F.col(c), F.lit(r"\E")))
    part = lambda p: F.when(F.contains(p, F.col("short")), F.when(whole_word(F.col("short")).isNotNull(), F.regexp_replace(p, whole_word(F.col("short")), F.col("short_label"))).otherwise(F.replace(p, F.col("short"), F.col("short_label")))).otherwise(p)
    cut = F.when(F.contains(x, F.col("long")), F.split(x, pattern("long"), -1)).otherwise(F.array(x))
    return both.select("work_id", "chunk_id", F.when(x.isNotNull(), F.call_function("array_join", F.transform(cut, part), F.col("long_label"))).alias("masked"))
