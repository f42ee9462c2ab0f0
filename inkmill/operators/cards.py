"""Technique cards and their evidence (E8, E11-E16, F10, G8): places, periods, verdicts, reinforcement, excerpts, schema.

Deliveries of an item count once, the latest.  A confidence is compared without case and outer space; null counts as
``high``, as a card without one does, and any other word steps down to ``low``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import latest, latest_texts
from inkmill.functions.text import strip
from inkmill.operators.evidence import evidence_pool, verify
from inkmill.operators.structure import interval_join


def confidence_of(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)), F.lit("high"))


def lowered(c: Column) -> Column:
    return F.when(c == "high", "mid").otherwise("low")


def era_spans(chunks: DataFrame) -> DataFrame:
    """(work_id, era, start, end): the stretch of each period of a work, from its first chunk to the end of its last."""
    once = chunks.where("era_id is not null")
    return once.groupBy("work_id", "era").agg(F.min("start_pos").alias("start"), F.max(F.col("start_pos") + F.length("chunk_text")).alias("end"))


def evidence_positions(chunks: DataFrame) -> DataFrame:
    """(work_id, evidence_id, chunk_id, era, start_pos, end_pos) of the pool's quotes on the axis of the work, half-open."""
    return evidence_pool(chunks, places=True).select("work_id", "evidence_id", "chunk_id", "era", "start_pos", (F.col("start_pos") + F.length("quote")).alias("end_pos"))


def quote_eras(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, era): the period in whose stretch the quote stands, else the label of its chunk; the item's own word is not read.

    Of several stretches that hold the place, the first in the order of their starts and names counts.
    """
    texts = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["start_pos", "chunk_text", "era"])
    cites = latest(items, ["item_id"], "ingested_at", ["work_id", "chunk_id", "quote"]).select("item_id", "work_id", F.lower(F.trim("chunk_id")).alias("chunk_id"), "quote").where("work_id is not null and chunk_id <> ''")
    at = F.instr("chunk_text", F.col("quote"))
    met = cites.join(texts, ["work_id", "chunk_id"]).select("item_id", "work_id", F.col("era").alias("label"), F.when(F.length("quote") > 0, F.when(at > 0, F.col("start_pos") + at - 1)).alias("pos"))
    found = interval_join(met, era_spans(chunks), "work_id", "pos", "start", "end", width=1_000_000)
    spans = era_spans(chunks).select("work_id", "era", "start")
    ranked = found.join(spans.select("work_id", "era", F.col("start").alias("s")), ["work_id", "era"], "left").groupBy("item_id").agg(F.min(F.when(F.col("era").isNotNull(), F.struct("s", "era"))).alias("e"), F.min("label").alias("label"))
    return ranked.select("item_id", F.coalesce("e.era", "label").alias("era"))


def verified_cards(cards: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(card_id, valid, fixed, downgraded, confidence): verdicts of a card's quotes; one downgraded quote lowers its confidence a step."""
    owner = latest(items, ["item_id"], "ingested_at", ["card_id"])
    counts = owner.join(verify(items, chunks), "item_id").groupBy("card_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "fixed", "downgraded")])
    out = cards.select("card_id", confidence_of(F.col("confidence")).alias("c")).join(counts, "card_id", "left").fillna(0, ["valid", "fixed", "downgraded"])
    return out.select("card_id", "valid", "fixed", "downgraded", F.when(F.col("downgraded") > 0, lowered(F.col("c"))).otherwise(F.col("c")).alias("confidence"))


def references(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, known, era): whether an item's evidence_id names an anchor of its work's pool, and that anchor's period."""
    cites = latest(items, ["item_id"], "ingested_at", ["work_id", "evidence_id"]).select("item_id", "work_id", strip(F.col("evidence_id")).alias("evidence_id")).where("evidence_id <> ''")
    pool = evidence_pool(chunks).select("work_id", "evidence_id", "era")
    return cites.join(pool, ["work_id", "evidence_id"], "left").select("item_id", F.col("era").isNotNull().alias("known"), "era")


def expanded(cards: DataFrame, refs: DataFrame, items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(card_id, evidence_id, chunk_id, quote, era) for references by id alone (card_id, evidence_id); ids the card already quotes are skipped, unknown ones too."""
    have = latest(items, ["item_id"], "ingested_at", ["card_id", "evidence_id"]).select("card_id", strip(F.col("evidence_id")).alias("evidence_id")).where("evidence_id is not null").distinct()
    wanted = refs.select("card_id", strip(F.col("evidence_id")).alias("evidence_id")).where("evidence_id <> ''").distinct().join(have, ["card_id", "evidence_id"], "left_anti")
    pool = evidence_pool(chunks).select("work_id", "evidence_id", "chunk_id", "quote", "era")
    return wanted.join(cards.select("card_id", "work_id"), "card_id").join(pool, ["work_id", "evidence_id"]).select("card_id", "evidence_id", "chunk_id", "quote", "era")


def reinforced(cards: DataFrame, items: DataFrame) -> DataFrame:
    """(card_id, problems, confidence) of the cards whose name or definition promises what none of their quotes shows.

    Marks (ellipsis, dash, exclamation, question), speech and comparisons are looked for; cards without quotes pass.
    """
    quote = F.coalesce("quote", F.lit(""))
    shows = {**{k: F.contains(quote, F.lit(mark)) for k, (_, mark) in L.PROMISED_MARKS.items()}, "speech": quote.rlike(L.SPEECH_SHOWN), "comparison": quote.rlike(L.COMPARISON_SHOWN)}
    own = latest(items, ["item_id"], "ingested_at", ["card_id", "quote"])
    seen = own.groupBy("card_id").agg(*[F.max(c).alias(k) for k, c in shows.items()])
    body = F.concat_ws(" ", F.coalesce("card_name", F.lit("")), F.coalesce("definition", F.lit("")))
    promised = {**{k: F.contains(F.col("body"), F.lit(term)) for k, (term, _) in L.PROMISED_MARKS.items()}, "speech": F.col("body").rlike("|".join(L.SPEECH_TERMS)), "comparison": F.col("body").rlike("|".join(L.COMPARISON_TERMS))}
    both = cards.select("card_id", body.alias("body"), confidence_of(F.col("confidence")).alias("c")).join(seen, "card_id")
    problems = F.filter(F.array(*[F.when(promised[k] & ~F.col(k), F.lit(k)) for k in promised]), lambda x: x.isNotNull())
    return both.select("card_id", problems.alias("p"), "c").where(F.size("p") > 0).select("card_id", F.array_join("p", ",").alias("problems"), lowered(F.col("c")).alias("confidence"))


def era_excerpts(chunks: DataFrame, most: int = 900) -> DataFrame:
    """(work_id, era, chunk_id, excerpt): the beginning of the middle chunk, in order of chunk ids, of each period of a work."""
    once = latest(chunks, ["work_id", "chunk_id"], "ingested_at", ["era"])
    n, i = F.count(F.lit(1)).over(Window.partitionBy("work_id", "era")), F.row_number().over(Window.partitionBy("work_id", "era").orderBy("chunk_id"))
    middle = once.withColumn("i", i).withColumn("n", n).where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("work_id", "chunk_id", "era")
    cut = chunks.select("work_id", "chunk_id", "ingested_at", F.substring(strip(F.col("chunk_text")), 1, most).alias("excerpt"))
    met = latest(cut.join(middle.select("work_id", "chunk_id"), ["work_id", "chunk_id"], "left_semi"), ["work_id", "chunk_id"], "ingested_at", ["excerpt"])
    return middle.join(met, ["work_id", "chunk_id"]).select("work_id", "era", "chunk_id", "excerpt")


def copy_references(chunks: DataFrame, most: int = 10) -> DataFrame:
    """(work_id, rank, chunk_id, era): chunks to compare trials with, in rounds over the periods, from the middle of each outwards.

    Taking the middle of what is left again and again walks to both sides in turn, to the right first where the number
    of chunks is odd, so the place from the middle gives the round.
    """
    once = latest(chunks, ["work_id", "chunk_id"], "ingested_at", ["era"])
    w = Window.partitionBy("work_id", "era")
    once = once.withColumn("i", F.row_number().over(w.orderBy("chunk_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("first", F.min("chunk_id").over(w))
    d = F.col("i") - F.floor(F.col("n") / 2)
    step = F.when(F.col("n") % 2 == 1, F.when(d > 0, 2 * d - 1).otherwise(-2 * d)).otherwise(F.when(d < 0, -2 * d - 1).otherwise(2 * d))
    out = once.withColumn("round", step).where(F.col("round") < most).withColumn("rank", F.row_number().over(Window.partitionBy("work_id").orderBy("round", "first")))
    return out.where(F.col("rank") <= most).select("work_id", "rank", "chunk_id", "era")


def card_schema(cards: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """(card_id, problems) of the cards that break their schema: empty or stock texts, 3 to 5 steps, enough quotes with a measure, known levels."""
    blank = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    own = latest(items, ["item_id"], "ingested_at", ["card_id", "quote", "metric"])
    counts = own.groupBy("card_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank("quote")).alias("no_quote"), F.count_if(blank("metric")).alias("no_metric"))
    both = cards.join(counts, "card_id", "left").fillna(0, ["n", "no_quote", "no_metric"])
    levels = ["high", "mid", "low"]
    rules = {
        "name": blank("card_name") | strip(F.col("card_name")).isin(L.STOCK_NAMES), "definition": blank("definition"), "trigger": blank("trigger_cond") | strip(F.col("trigger_cond")).isin(L.STOCK_TRIGGERS),
        "steps": ~F.coalesce(F.size("steps"), F.lit(0)).between(3, 5), "boundary": blank("boundary"), "evidence": F.col("n") < least, "quote": (F.col("n") >= least) & (F.col("no_quote") > 0), "metric": (F.col("n") >= least) & (F.col("no_metric") > 0),
        "counterexample": blank("counterexample"), "purpose": blank("serves_purpose"),
        "transferability": ~F.coalesce(F.lower(strip(F.col("transferability"))).isin(levels), F.lit(False)), "confidence": ~F.coalesce(F.lower(strip(F.col("confidence"))).isin(levels), F.lit(False)),
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return both.select("card_id", problems.alias("p")).where(F.size("p") > 0).select("card_id", F.array_join("p", ",").alias("problems"))


def contract_fields(contracts: DataFrame, clauses: DataFrame) -> DataFrame:
    """(contract_id, n_clauses, complete): three fields of at least five characters and two to four clauses.

    ``clauses`` has one row per contract_id and clause, as cut from the packed field.
    """
    long_ = lambda c: F.length(F.coalesce(strip(F.col(c)), F.lit(""))) >= 5
    once = contracts.select("contract_id", (long_("positioning") & long_("purpose") & long_("style_marks_synthesis")).alias("fields")).distinct()
    counts = clauses.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    return once.join(counts, "contract_id", "left").fillna(0, ["n_clauses"]).select("contract_id", "n_clauses", (F.col("fields") & F.col("n_clauses").between(2, 4)).alias("complete"))
