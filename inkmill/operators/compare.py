"""Comparison over periods and against references (M1, F2, F5, F7, F9): trends, bands, n-gram overlap, copy risk, scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.codepoints import decode, parts
from inkmill.functions.frames import latest_texts
from inkmill.functions.text import grams as text_grams
from inkmill.functions.text import strip
from inkmill.operators.style import ratio, style_core

MEASURES = {"avg_sentence": ("sentence_chars", "n_sentences"), "short_share": ("short_sentences", "n_sentences"), "long_share": ("long_sentences", "n_sentences"), "avg_paragraph": ("paragraph_chars", "n_paragraphs")}
MOST_BROADCAST = 2_000_000
SIZES = (5, 7, 40)
MOST_BITS = 27


def trend(v: Column) -> Column:
    """rising, falling, steady, shifting or too_few, by net change over the length of the path (never by a fitted slope)."""
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    spread = (F.array_max(v) - F.array_min(v)) / F.abs(mean)
    net = F.element_at(v, -1) - F.element_at(v, 1)
    path = F.aggregate(F.sequence(F.lit(2), n), F.lit(0.0), lambda s, i: s + F.abs(F.element_at(v, i) - F.element_at(v, i - 1)))
    flat = F.array_max(v) == F.array_min(v)
    return (
        F.when(n < 2, "too_few").when(flat, "steady").when(mean == 0, "shifting").when(spread <= 0.10, "steady")
        .when(F.abs(net) / path >= 0.5, F.when(net > 0, "rising").otherwise("falling")).otherwise("shifting")
    )


def era_measures(chunks: DataFrame) -> DataFrame:
    """Summed counts per work and period: additive over chunks, combined before the shuffle, so a hot work is no matter.

    Chunks without one of the five periods belong to none and are not counted.
    """
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text", "era"])
    core = style_core(once.where(F.col("era").isin(L.ERAS)), ["work_id", "chunk_id", "era"], "chunk_text")
    sums = sorted({c for pair in MEASURES.values() for c in pair})
    return core.groupBy("work_id", "era").agg(*[F.sum(c).alias(c) for c in sums])


def era_trends(chunks: DataFrame) -> DataFrame:
    """(work_id, measure, eras, trend) over the periods of each work in book order."""
    place = F.array_position(F.array(*map(F.lit, L.ERAS)), F.col("era"))
    long_ = era_measures(chunks).select("work_id", place.alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), ratio(F.col(a), F.col(b)).alias("v")) for k, (a, b) in MEASURES.items()])).alias("m"))
    seq = long_.groupBy("work_id", "m.measure").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m.v"))), lambda x: x["v"]).alias("v"))
    return seq.select("work_id", "measure", F.size("v").alias("eras"), trend(F.col("v")).alias("trend"))


def mad_bands(df: DataFrame, group: str, value: str, k: int = 3, least: int = 4) -> DataFrame:
    """Median and tolerance band (median +- k deviations) of a whole-number measure per group of at least ``least`` rows.

    Exact ranks are read from counts per (group, value), so no group is gathered in one task.
    """
    from pyspark.sql import Window

    def median(rows: DataFrame, v: str, into: str) -> DataFrame:
        counts = rows.groupBy(group, v).agg(F.count(F.lit(1)).alias("c"))
        w = Window.partitionBy(group).orderBy(v)
        counts = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
        low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
        at = lambda r: F.min(F.when(F.col("upto") >= r, F.col(v)))
        return counts.groupBy(group).agg(((at(low) + at(high)) / 2.0).alias(into), F.max("n").alias("n"))

    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    mid = median(rows, "v", "median")
    mad = median(rows.join(mid.select(group, "median"), group).select(group, F.abs(F.col("v") - F.col("median")).alias("d")), "d", "mad").select(group, "mad")
    out = mid.where(F.col("n") >= least).join(mad, group)
    width = F.when(F.col("mad") != 0, F.col("mad")).when(F.col("median") != 0, F.abs("median") * 0.05).otherwise(0.5)
    return out.select(group, "n", "median", F.greatest(F.lit(0.0), F.col("median") - k * width).alias("low"), (F.col("median") + k * width).alias("high"))


def sized_grams(text: str, sizes: tuple[int, ...]) -> Column:
    """(n, g) of all character n-grams of the sizes."""
    return F.concat(*[_tagged(text, n) for n in sizes])


def _tagged(text: str, n: int) -> Column:
    return F.transform(text_grams(F.col(text), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))


def copy_risk(trials: DataFrame, key: str, text: str, references: DataFrame, reference_text: str) -> DataFrame:
    """Risk per trial: a common stretch of 40 characters, or many common 5- and 7-grams; short trials by the stretch alone.

    The n-grams of all three sizes are made in one pass over each side and met in one join.
    """
    base = trials.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))
    known = references.select(F.explode(sized_grams(reference_text, SIZES)).alias("x")).select("x.n", "x.g").distinct()
    small = known.count() <= MOST_BROADCAST
    if small:
        known = F.broadcast(known)
    own = base.select(key, F.explode(sized_grams("t", SIZES)).alias("x")).select(key, "x.n", "x.g", F.lit(1).alias("c"))
    if not small:  # else every gram is met in place, and only sums are moved
        own = own.groupBy(key, "n", "g").agg(F.sum("c").alias("c"))
    met = own.join(known.withColumn("hit", F.lit(1)), ["n", "g"], "left")
    per = met.groupBy(key).agg(*[F.coalesce(F.sum(F.when((F.col("n") == n) & wanted, F.col("c"))), F.lit(0)).alias(f"{name}_{n}") for n in SIZES for name, wanted in (("shared", F.col("hit") == 1), ("total", F.lit(True)))])
    return at_risk(base.select(key, F.length("t").alias("n_chars")).join(per, key, "left").fillna(0, [f"{name}_{n}" for n in SIZES for name in ("shared", "total")]))


def at_risk(out: DataFrame) -> DataFrame:
    often = (F.col("shared_5") * 100 >= F.col("total_5") * 35) & (F.col("shared_7") * 100 >= F.col("total_7") * 15) & (F.col("n_chars") >= 200)
    return out.withColumn("at_risk", (F.col("shared_40") > 0) | often)


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of a row of code points, put together from those of 1, 2, 4 ... characters."""
    with np.errstate(over="ignore"):
        h = points.astype(np.uint64) + np.uint64(n << 32)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        out, done, width, power = None, 0, 1, 0x9E3779B97F4A7C15
        while done < n:
            if n & width:
                more = h[done:]
                out = h if out is None else out[: len(more)] * np.uint64(power) + more
                done += width
            h, power, width = h[: max(0, len(h) - width)] * np.uint64(power) + h[width:], power * power % (1 << 64), 2 * width
        return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def row_hashes(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the n-grams within each text."""
    points, offsets = decode(column)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(points) < n:
        return row[:0], np.zeros(0, np.uint64)
    inside = row[: len(row) - n + 1] == row[n - 1 :]
    return row[: len(inside)][inside], hashes(points, n)[inside]


def corpus_copy_risk(trials: DataFrame, key: str, text: str, references: DataFrame, reference_text: str) -> DataFrame:
    """copy_risk against references of any size; repeated deliveries change nothing, as a gram is there or not.

    n-grams are compared by 64-bit hashes. A bit map of bounded size, made from the trials, drops most grams of the
    references before the shuffle; what passes is joined by the whole hash.
    """
    base = trials.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                for n in SIZES:
                    row, h = row_hashes(part.column(1), n)
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
                    count = np.diff(np.concatenate((first, [len(h)])))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[first])), pa.array(np.full(len(first), n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(count.astype(np.int64))], [key, "n", "h", "c"])

    mine = base.mapInArrow(own, f"`{key}` {base.schema[key].dataType.simpleString()}, n int, h long, c long")
    size = len(SIZES) * (base.agg(F.sum(F.length("t")).alias("m")).first()["m"] or 0)
    bits = min(MOST_BITS, max(16, (16 * size).bit_length()))

    def places(h: np.ndarray) -> list[np.ndarray]:
        return [h >> np.uint64(64 - bits), (h << np.uint64(bits)) >> np.uint64(64 - bits)]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for part in parts(batch):
                for n in SIZES:
                    for at in places(row_hashes(part.column(0), n)[1]):
                        np.bitwise_or.at(table, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(table)
        for k in range(0, len(used), 100_000):
            w = used[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(table[w].view(np.int64))], ["w", "b"])

    words = base.select("t").mapInArrow(marked, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = trials.sparkSession.sparkContext.broadcast(filled)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in parts(batch):
                found = []
                for n in SIZES:
                    h = row_hashes(part.column(0), n)[1]
                    for k in (0, 1):
                        at = places(h)[k]
                        h = h[(table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
                    found.append(np.unique(h))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    known = references.select(F.col(reference_text)).where(F.col(reference_text).isNotNull()).mapInArrow(met, "h long").distinct()
    hits = mine.join(known, "h").groupBy(key).agg(*[F.sum(F.when(F.col("n") == n, F.col("c")).otherwise(0)).alias(f"shared_{n}") for n in SIZES])
    out = base.select(key, F.length("t").alias("n_chars")).join(hits, key, "left").fillna(0, [f"shared_{n}" for n in SIZES])
    columns = [c for n in SIZES for c in (F.col(f"shared_{n}"), F.greatest(F.col("n_chars") - n + 1, F.lit(0)).cast("long").alias(f"total_{n}"))]
    return at_risk(out.select(key, "n_chars", *columns))


def scenes(df: DataFrame, key: str, text: str) -> DataFrame:
    """Scenes of each text, divided by lines of three or more hyphens or equals signs."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"(?md)^[ \t\x{3000}]*(?:-{3,}|={3,})[ \t\x{3000}\r]*$", -1), lambda s: F.length(strip(s))), lambda n: n > 0)
    return df.select(key, F.size(parts).alias("n_scenes"), F.coalesce(F.array_min(parts), F.lit(0)).alias("shortest"), (F.size(parts).between(2, 3) & (F.coalesce(F.array_min(parts), F.lit(0)) >= 800)).alias("meets"))
