"""Noise lines (N1-N7): split, classify, drop; every step is an expression of one row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.frames import latest_texts
from inkmill.functions.lexicons import CORRUPT, DIVIDER, LINE, LINK, NAVIGATION, NOTE_WORDS, PLATFORM
from inkmill.functions.text import contains_any, strip, total

KINDS = ["platform_notes", "watermarks", "structural_dividers", "corrupted_lines"]


def lines(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def classified(found: Column) -> Column:
    """Per line struct(kind, size, out): kind is blank, kept or a kind of noise; out is what stays of the line.

    Each step is a transform of its own: inside a lambda a repeated expression would be evaluated again.
    """
    scrubbed = F.transform(found, lambda x: F.struct(x.alias("x"), F.when(x.rlike(CORRUPT), F.regexp_replace(x, CORRUPT, "")).otherwise(x).alias("y")))
    cored = F.transform(scrubbed, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), strip(s["y"]).alias("c")))
    return F.transform(F.transform(cored, _kind), lambda s: F.struct(s["kind"].alias("kind"), F.length(s["x"]).cast("long").alias("size"), F.when(s["kind"] == "blank", s["x"]).when(s["kind"] == "kept", s["y"]).otherwise("").alias("out")))


def _kind(s: Column) -> Column:
    x, y, c = s["x"], s["y"], s["c"]
    noisy = F.when(contains_any(c, NOTE_WORDS), "platform_notes").otherwise("watermarks")
    kind = (
        F.when((c == "") & (strip(x) == ""), "blank")
        .when((F.length(y) != F.length(x)) & (F.length(c) < 2), "corrupted_lines")
        .when(c.rlike(DIVIDER), "structural_dividers")
        .when(c.rlike(f"{PLATFORM}|{NAVIGATION}|{LINK}"), noisy)
        .otherwise("kept")
    )
    return F.struct(x.alias("x"), y.alias("y"), kind.alias("kind"))


def _count(kind: str) -> Column:
    return F.size(F.filter("lines", lambda x: x["kind"] == kind)).cast("long").alias(kind)


def with_clean(df: DataFrame, text: str) -> DataFrame:
    """df with ``lines`` (classified) and ``clean`` text.  A null text has null lines and null clean text."""
    return df.withColumn("lines", classified(lines(F.col(text)))).withColumn("clean", F.array_join(F.transform("lines", lambda x: x["out"]), ""))


def noise_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts per text; null and empty texts count as empty."""
    picked = with_clean(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    gone = F.filter("lines", lambda x: F.array_contains(F.array(*map(F.lit, KINDS)), x["kind"]))
    return picked.select(
        key,
        F.length("t").cast("long").alias("raw_chars"),
        F.length("clean").cast("long").alias("clean_chars"),
        total(F.transform(gone, lambda x: x["size"])).alias("removed_chars"),
        F.size(gone).cast("long").alias("removed_lines"),
        *[_count(k) for k in KINDS],
    )


def noise_shares(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, removed_share): removed characters over all; empty texts have 0."""
    return noise_stats(df, key, text).select(key, (F.col("removed_chars") / F.greatest("raw_chars", F.lit(1)).cast("double")).alias("removed_share"))


def work_noise(chunks: DataFrame) -> DataFrame:
    """Noise counts of whole works, each delivery once: the sums over their chunks, combined before the shuffle."""
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text"]).withColumn("k", F.struct("work_id", "chunk_id"))
    counts = noise_stats(once, "k", "chunk_text")
    return counts.groupBy(F.col("k.work_id").alias("work_id")).agg(*[F.sum(c).alias(c) for c in counts.columns if c != "k"])
