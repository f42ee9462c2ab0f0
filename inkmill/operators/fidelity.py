"""Fidelity of trial texts to a work (E17, M2, F1-F4, F6, F8, F11-F13): scenes, period windows, bands, deviations, cards, verdict.

A trial is compared with the work of its title (without case and outer space; the first work_id of several).  Measures
of a work are sums over its chunks.  Ratios are unrounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.codepoints import decode
from inkmill.functions.frames import Shared, latest_texts, materialise
from inkmill.functions.probes import Sums
from inkmill.functions.text import count, count_word, strip, total
from inkmill.operators.compare import trend
from inkmill.operators.dialogue import quotes
from inkmill.operators.noise import lines
from inkmill.operators.ratios import measures, quoted_chars, simile_count
from inkmill.operators.style import prepared, ratio

LEAST_SCENE = 800


def scene_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scene, text): parts between lines of hyphens or equals signs or ``# 场景`` headings; a heading begins its scene."""
    t = F.coalesce(F.col(text), F.lit(""))
    marks = F.regexp_extract_all(t, F.lit(L.SCENE_MARK), F.lit(0))
    cut = df.select(key, F.split(t, L.SCENE_MARK, -1).alias("p"), F.transform(marks, lambda m: strip(m)).alias("m"))
    head = lambda i: F.when((i > 0) & F.startswith(F.get("m", i - 1), F.lit("#")), F.concat(F.get("m", i - 1), F.lit("\n"))).otherwise("")
    parts = F.filter(F.transform("p", lambda x, i: strip(F.concat(head(i), x))), lambda x: x != "")
    return cut.select(key, F.posexplode(parts).alias("i", "text")).select(key, (F.col("i") + 1).alias("scene"), "text")


def scene_type(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(L.SCENE_TYPES):
        out = F.when(F.left(text, F.lit(40)).rlike("|".join(words)), name).otherwise(out)
    return out


def scene_checks(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text: scenes, those too short, types missing (null if no scene has one), and whether all is met."""
    per = scene_texts(df, key, text).groupBy(key).agg(F.count(F.lit(1)).alias("n_scenes"), F.count_if(F.length("text") < LEAST_SCENE).alias("short_scenes"), F.collect_set(scene_type(F.col("text"))).alias("types"))
    out = df.select(key).join(per, key, "left").select(key, F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), F.coalesce("short_scenes", F.lit(0)).alias("short_scenes"), "types")
    missing = F.when(F.size("types") > 0, F.array_join(F.array_except(F.array(*[F.lit(n) for n, _ in L.SCENE_TYPES]), F.col("types")), ","))
    out = out.select(key, "n_scenes", "short_scenes", missing.alias("missing_types"))
    return out.select("*", (F.col("n_scenes").between(2, 3) & (F.col("short_scenes") == 0) & (F.coalesce("missing_types", F.lit("")) == "")).alias("meets"))


def scene_measures(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scene, chars, avg_sentence, quoted_share) of every scene."""
    parts = scene_texts(df, key, text)
    return measures(parts, [key, "scene"], "text").join(parts.select(key, "scene", F.length("text").alias("chars")), [key, "scene"]).select(key, "scene", "chars", F.col("avg").alias("avg_sentence"), F.col("quoted").alias("quoted_share"))


SUMS = ["total_chars", "n_sentences", "sentence_chars", "short_sentences", "long_sentences", "n_paragraphs", "paragraph_chars", "quoted", "similes"]


def chunk_sums(chunks: DataFrame) -> DataFrame:
    """(work_id, chunk_id, era) with the additive counts of every chunk, each delivery once."""
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text", "era"])
    base = prepared(once, ["work_id", "chunk_id", "era"], "chunk_text").withColumn("lens", F.transform("sents", lambda s: F.length(s).cast("long")))
    size = lambda a: F.size(a).cast("long")
    return base.select(
        "work_id", "chunk_id", "era", "clean", "total_chars", size("sents").alias("n_sentences"), total(F.col("lens")).alias("sentence_chars"), size(F.filter("lens", lambda n: n <= 10)).alias("short_sentences"),
        size(F.filter("lens", lambda n: n >= 50)).alias("long_sentences"), size("paras").alias("n_paragraphs"), total(F.col("paras")).alias("paragraph_chars"), quoted_chars(F.col("clean")).alias("quoted"), simile_count("sents").alias("similes"),
    )


def era_windows(chunks: DataFrame, least: int = 200) -> DataFrame:
    """Summed counts per work and period of at least ``least`` characters; combined before the shuffle."""
    return windows_of(chunk_sums(chunks), least)


def windows_of(sums: DataFrame, least: int = 200) -> DataFrame:
    return sums.where(F.col("era").isin(L.ERAS)).groupBy("work_id", "era").agg(*[F.sum(c).alias(c) for c in SUMS]).where(F.col("total_chars") >= least)


def window_values(windows: DataFrame) -> DataFrame:
    c = F.col
    return windows.select(
        "work_id", *[k for k in ("era",) if k in windows.columns], ratio(c("sentence_chars"), c("n_sentences")).alias("avg_sentence"), ratio(c("short_sentences"), c("n_sentences")).alias("short_share"), ratio(c("long_sentences"), c("n_sentences")).alias("long_share"),
        ratio(c("paragraph_chars"), c("n_paragraphs")).alias("avg_paragraph"), ratio(c("quoted"), c("total_chars")).alias("quoted_share"), (c("similes") * F.lit(1000.0) / F.greatest(c("total_chars"), F.lit(1)).cast("double")).alias("simile_density"),
    )


def era_matrix(chunks: DataFrame) -> DataFrame:
    """(work_id, measure, eras, mean, trend) of six measures over the periods of each work in book order."""
    windows = era_windows(chunks)
    once = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text", "era"]).where(F.col("era").isin(L.ERAS))
    runs = prepared(once, ["work_id", "era"], "chunk_text").select("work_id", "era", F.explode(F.regexp_extract_all("clean", F.lit(L.CJK + "{2,}"), F.lit(0))).alias("r"))
    words = runs.select("work_id", "era", F.explode(F.transform(F.sequence(F.lit(1), F.length("r") - 1), lambda i: F.substring(F.col("r"), i, F.lit(2)))).alias("word")).groupBy("work_id", "era", "word").agg(F.count(F.lit(1)).alias("n"))
    rich = words.groupBy("work_id", "era").agg(ratio(F.count(F.lit(1)), F.sum("n")).alias("vocabulary"))
    values = window_values(windows).join(rich, ["work_id", "era"], "left")
    names = ["avg_sentence", "short_share", "long_share", "avg_paragraph", "quoted_share", "vocabulary"]
    place = F.array_position(F.array(*map(F.lit, L.ERAS)), F.col("era"))
    long_ = values.select("work_id", place.alias("p"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in names])).alias("m")).where("m.v is not null")
    seq = long_.groupBy("work_id", "m.measure").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m.v"))), lambda x: x["v"]).alias("v"))
    return seq.select("work_id", "measure", F.size("v").alias("eras"), (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("mean"), trend(F.col("v")).alias("trend"))


COMPARED = ["avg_sentence", "short_share", "quoted_share", "simile_density"]
#: How far a measure may be from the reference: as a share of it, or as a difference.
TOLERANCE = {"avg_sentence": ("share", 0.15), "short_share": ("difference", 0.10), "quoted_share": ("difference", 0.10), "simile_density": ("share", 0.30)}


def median_of(v: Column) -> Column:
    s, n = F.array_sort(v), F.size(v)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2.0


def window_bands(chunks: DataFrame, k: int = 3, least: int = 4) -> DataFrame:
    """(work_id, measure, median, low, high): tolerance bands of works with at least ``least`` period windows."""
    return bands_of(era_windows(chunks), k, least)


def bands_of(windows: DataFrame, k: int = 3, least: int = 4) -> DataFrame:
    long_ = window_values(windows).select("work_id", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in COMPARED])).alias("m"))
    per = long_.groupBy("work_id", "m.measure").agg(F.collect_list("m.v").alias("v")).where(F.size("v") >= least).withColumn("median", median_of(F.col("v")))
    per = per.withColumn("mad", median_of(F.transform("v", lambda x: F.abs(x - F.col("median")))))
    width = F.when(F.col("mad") != 0, F.col("mad")).when(F.col("median") != 0, F.abs("median") * 0.05).otherwise(0.5)
    return per.select("work_id", "measure", "median", F.greatest(F.lit(0.0), F.col("median") - k * width).alias("low"), (F.col("median") + k * width).alias("high"))


def trials_of(documents: DataFrame, works: DataFrame) -> DataFrame:
    """(doc_id, work_id, text) of the trial writings whose title is a work's."""
    key = lambda c: F.lower(strip(F.col(c)))
    titles = works.select(key("title").alias("t"), "work_id").where("t <> ''").groupBy("t").agg(F.min("work_id").alias("work_id"))
    return documents.where("doc_kind = 'trial'").select("doc_id", key("work_title").alias("t"), F.coalesce("text", F.lit("")).alias("text")).join(titles, "t").select("doc_id", "work_id", "text")


def deviations(documents: DataFrame, works: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, measure, reference, trial, deviation, basis, passed): trial against work, by fixed tolerance or the work's own band."""
    own = trials_of(documents, works)
    per = materialise(chunk_sums(chunks).groupBy("work_id", "era").agg(*[F.sum(c).alias(c) for c in SUMS]))
    sums = per.groupBy("work_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    unpivot = lambda df, keys, into: df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in COMPARED])).alias("m")).select(*keys, "m.measure", F.col("m.v").alias(into))
    reference = unpivot(window_values(sums), ["work_id"], "reference")
    read = measures(own, ["doc_id", "work_id"], "text").select("doc_id", "work_id", F.col("avg").alias("avg_sentence"), (F.col("short") / 100.0).alias("short_share"), F.col("quoted").alias("quoted_share"), F.col("simile").alias("simile_density"))
    both = unpivot(read, ["doc_id", "work_id"], "trial").join(reference, ["work_id", "measure"]).join(bands_of(windows_of(per)).select("work_id", "measure", "low", "high"), ["work_id", "measure"], "left")
    relative = F.col("measure").isin([m for m, (mode, _) in TOLERANCE.items() if mode == "share"])
    limit = F.coalesce(*[F.when(F.col("measure") == m, F.lit(x)) for m, (_, x) in TOLERANCE.items()])
    gap = F.abs(F.col("trial") - F.col("reference"))
    both = both.where(~relative | (F.col("reference") > 0)).withColumn("deviation", F.when(relative, gap / F.col("reference")).otherwise(gap)).withColumn("inside", F.coalesce(F.col("trial").between(F.col("low"), F.col("high")), F.lit(False)))
    return both.select("doc_id", "measure", "reference", "trial", "deviation", F.when(F.col("inside"), "author_band").otherwise("fixed_tolerance").alias("basis"), (F.col("inside") | (F.col("deviation") <= limit)).alias("passed"))


def card_profile(body: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, terms, _ in reversed(L.CARD_PROFILES):
        out = F.when(body.rlike("|".join(terms)), name).otherwise(out)
    return out


def card_use(documents: DataFrame, works: DataFrame, cards: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, card_id, profile, status): whether a trial shows what each card of its work is about.

    Marks tell ``covered`` from ``uncovered``; too many ellipses or dashes make it ``deformed``; the work's leading
    speech tag must be there; rhythm is told from lines; a card without a known profile is ``not_applicable``.
    """
    own = trials_of(documents, works)
    body = F.concat_ws(" ", F.coalesce("card_name", F.lit("")), F.coalesce("definition", F.lit("")), F.array_join("steps", " "))
    named = cards.select("card_id", "work_id", card_profile(body).alias("profile"))
    tags = quotes(latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text"]), "work_id", "chunk_text").where("tag is not null").groupBy("work_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    top = tags.groupBy("work_id").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("top_tag"))
    t, p = F.col("text"), F.col("profile")
    shown = F.coalesce(*[F.when(p == name, F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(t, m))) > 0) for name, _, marks in L.CARD_PROFILES if marks])
    paras = F.filter(F.transform(lines(t), lambda x: F.length(strip(x))), lambda n: n > 0)
    most = F.greatest(F.lit(3), F.floor(F.length(t) / 350))
    status = (
        F.when(p.isNull(), "not_applicable")
        .when(p == "rhythm", F.when((F.size(F.filter(paras, lambda n: n <= 8)) > 0) | (F.size(paras) >= 3), "covered").otherwise("uncovered"))
        .when(~shown, "uncovered")
        .when((p == "ellipsis") & (count_word(t, "……") > most) | (p == "dash") & (count_word(t, "——") > most), "deformed")
        .when((p == "dialogue_tag") & ~F.coalesce(F.contains(t, F.col("top_tag")), F.lit(True)), "uncovered")
        .otherwise("covered")
    )
    return own.join(named, "work_id").join(top, "work_id", "left").select("doc_id", "card_id", "profile", status.alias("status"))


def verdicts(documents: DataFrame, works: DataFrame, cards: DataFrame, chunks: DataFrame, copies: DataFrame) -> DataFrame:
    """One row per trial of a known work: measures, cards, copies (``doc_id``, ``at_risk``) and scenes, and all together."""
    own = trials_of(documents, works).select("doc_id", "text")
    measured = deviations(documents, works, chunks).groupBy("doc_id").agg(F.min("passed").alias("measures_passed"))
    used = card_use(documents, works, cards, chunks).groupBy("doc_id").agg(F.count_if(F.col("status").isin("uncovered", "deformed")).alias("blocking"), F.count_if(F.col("status") != "not_applicable").alias("applicable"))
    out = own.join(scene_checks(own, "doc_id", "text").select("doc_id", F.col("meets").alias("scenes_passed")), "doc_id").join(measured, "doc_id", "left").join(used, "doc_id", "left").join(copies.select("doc_id", (~F.col("at_risk")).alias("copies_passed")), "doc_id", "left")
    out = out.select("doc_id", F.coalesce("measures_passed", F.lit(True)).alias("measures_passed"), F.coalesce("blocking", F.lit(0)).alias("blocking_cards"), F.coalesce("applicable", F.lit(0)).alias("applicable_cards"), F.coalesce("copies_passed", F.lit(True)).alias("copies_passed"), "scenes_passed")
    return out.select("*", (F.col("measures_passed") & (F.col("blocking_cards") == 0) & F.col("copies_passed") & F.col("scenes_passed")).alias("passed"))


MOST_REFERENCE = 20_000_000


class Stretches:
    """Hashes of all stretches of one length of the references, kept for the lengths asked for."""

    def __init__(self, value: tuple[np.ndarray, np.ndarray]) -> None:
        points, self.offsets = value
        self.sums, self.kept = Sums(points), {}
        self.length = np.diff(self.offsets)

    def of(self, n: int) -> np.ndarray:
        if n not in self.kept:
            if len(self.kept) >= 64:
                self.kept.pop(next(iter(self.kept)))
            row = np.repeat(np.arange(len(self.length)), np.maximum(self.length - n + 1, 0))
            at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(self.length - n + 1, 0)) - np.maximum(self.length - n + 1, 0), np.maximum(self.length - n + 1, 0)) + self.offsets[row]
            self.kept[n] = np.unique(self.sums.of(at, n))
        return self.kept[n]

    def longest(self, points: np.ndarray) -> int:
        """Length of the longest stretch shared with a reference; a shared stretch shares all shorter ones, so halving finds it."""
        sums, low, high = Sums(points), 0, min(len(points), int(self.length.max()) if len(self.length) else 0)
        while low < high:
            n = (low + high + 1) // 2
            known = self.of(n)
            mine = sums.of(np.arange(len(points) - n + 1), n)
            at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            low, high = (n, high) if len(known) and (known[at] == mine).any() else (low, n - 1)
        return low


def longest_shared(texts: DataFrame, key: str, text: str, references: DataFrame, reference_text: str, most_chars: int = MOST_REFERENCE) -> DataFrame:
    """(key, longest): characters of the longest stretch a text shares with any reference, over whole texts, by 64-bit hashes.

    References of more than ``most_chars`` characters are taken in blocks, one scan of the texts a block.  Nulls and empty texts share 0.
    """
    refs = references.select(F.col(reference_text).alias("t")).where(F.length("t") > 0).distinct()
    size = refs.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = -(-size // most_chars) or 1
    picked = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"))

    def scan(block: int) -> DataFrame:
        mine = refs.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block) if blocks > 1 else refs
        table = mine.toArrow()
        shared = Shared(texts.sparkSession, decode(table["t"].combine_chunks()) if table.num_rows else (np.zeros(0, np.uint32), np.zeros(1, np.int64)), Stretches)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points, offsets = decode(batch.column(1))
                found = [shared.get().longest(points[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], [key, "longest"])

        return picked.mapInArrow(run, f"`{key}` {picked.dtypes[0][1]}, longest long")

    scans = [scan(b) for b in range(blocks)]
    return scans[0] if blocks == 1 else reduce(DataFrame.unionByName, scans).groupBy(key).agg(F.max("longest").alias("longest"))
