"""The registered queries of the text operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions.frames import latest, latest_texts, table

from . import containers, leakage, lookalike_text, scan_noise, splitting, subjects
from . import sentences as sentence_ops


def _books(spark: SparkSession, directory: str) -> list[DataFrame]:
    return [table(spark, directory, name) for name in ("evidence_store", "works", "chapters")]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    return scan_noise.noise_kinds(*_books(spark, directory))


def p1_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return scan_noise.repair(*_books(spark, directory))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike_text.lookalike_pairs(table(spark, directory, "evidence_item"), "item_id", "work_id", "quote", "ingested_at")


def p2_classes(spark: SparkSession, directory: str) -> DataFrame:
    return lookalike_text.look_classes(table(spark, directory, "evidence_item"), "item_id", "work_id", "quote", "ingested_at")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    chunks = splitting.oversized(table(spark, directory, "evidence_store"), 2400)
    pieces = splitting.split(chunks, "chunk_text", ["work_id", "chunk_id"], with_text=False)
    return pieces.where("n_pieces > 1").select("work_id", "chunk_id").distinct()


def p4_pieces(spark: SparkSession, directory: str) -> DataFrame:
    chunks = latest_texts(splitting.oversized(table(spark, directory, "evidence_store"), 2400), ["work_id", "chunk_id"], "ingested_at", ["chunk_text"])
    return splitting.split(chunks, "chunk_text", ["work_id", "chunk_id"])


def p4_coverage(spark: SparkSession, directory: str) -> DataFrame:
    """Per oversized chunk: its characters as its pieces hold them, each once, and whether limit and overlaps are kept."""
    span = F.col("end_pos") - F.col("start_pos") + 1
    shared = F.lag("end_pos").over(Window.partitionBy("work_id", "chunk_id").orderBy("piece_no")) - F.col("start_pos") + 1
    pieces = p4_pieces(spark, directory).select("work_id", "chunk_id", "piece_no", span.alias("n"), shared.alias("shared"), (F.length("piece_text") == span).alias("whole"))
    return pieces.groupBy("work_id", "chunk_id").agg((F.sum("n") - F.coalesce(F.sum("shared"), F.lit(0))).alias("n_chars"), (F.max("n") <= 2400).alias("within_limit"), F.min(F.coalesce(F.col("shared").between(100, 200), F.lit(True)) & F.col("whole")).alias("overlaps_kept"))


def p4_item_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.assign_pieces(table(spark, directory, "evidence_store"), table(spark, directory, "evidence_item"))


def p5_sentences(spark: SparkSession, directory: str) -> DataFrame:
    chunks = latest_texts(table(spark, directory, "evidence_store"), ["work_id", "chunk_id"], "ingested_at", ["chunk_text"])
    return sentence_ops.sentences(chunks, "chunk_text", ["work_id", "chunk_id"])


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    chunks = table(spark, directory, "evidence_store").where(F.col("origin").isin("ebook", "web"))
    found = sentence_ops.sentence_starts(chunks, "chunk_text", ["work_id", "chunk_id", "ingested_at"])
    found = latest(found, ["work_id", "chunk_id"], "ingested_at", ["starts"])
    return found.select("work_id", "chunk_id", F.explode(F.col("starts").cast("array<bigint>")).alias("start_pos"))


def p6_containers(spark: SparkSession, directory: str) -> DataFrame:
    return containers.containers(table(spark, directory, "documents"))


def p6_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Per document: whether it came out once and whole, or in consecutive pieces if it is longer than a container, and whether its containers hold."""
    rows = p6_containers(spark, directory)
    filled = rows.groupBy("container_id").agg((F.sum("n_tokens") <= 2048).alias("holds"))
    per = rows.join(filled, "container_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n_tokens").alias("t"), F.min("piece_no").alias("first"), F.max("piece_no").alias("last"), F.countDistinct("piece_no").alias("different"), F.min("holds").alias("holds"))
    whole = F.when(F.col("t") <= 2048, (F.col("k") == 1) & (F.col("last") == 0)).otherwise((F.col("first") == 1) & (F.col("last") == F.col("k")) & (F.col("different") == F.col("k")) & (F.col("k") == F.ceil(F.col("t") / 2048)))
    return per.select("doc_id", whole.alias("whole"), "holds")


def p7_leaks(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    found = leakage.leaks(table(spark, directory, "documents"), table(spark, directory, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    areas = subjects.subject_areas(table(spark, directory, "documents"), table(spark, directory, "subject_labels"), table(spark, directory, "subjects"))
    return areas.select("doc_id", "subject").distinct()


def p8_composition(spark: SparkSession, directory: str) -> DataFrame:
    areas = subjects.subject_areas(table(spark, directory, "documents"), table(spark, directory, "subject_labels"), table(spark, directory, "subjects"))
    return areas.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


def p2_canonical(spark: SparkSession, directory: str) -> DataFrame:
    items = latest(table(spark, directory, "evidence_item"), ["item_id"], "ingested_at", ["quote"])
    return lookalike_text.canonical(items, "quote", "canonical_quote", ["item_id"])


QUERIES = {
    "p1_found": p1_found, "p1_repaired": p1_repaired,
    "p2_found": p2_found, "p2_canonical": p2_canonical, "p2_classes": p2_classes,
    "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_coverage": p4_coverage, "p4_item_pieces": p4_item_pieces,
    "p5_found": p5_found, "p5_sentences": p5_sentences,
    "p6_containers": p6_containers, "p6_documents": p6_documents,
    "p7_found": p7_found, "p7_leaks": p7_leaks,
    "p8_found": p8_found, "p8_composition": p8_composition,
}
ORACLES = {
    "p4_found": "SELECT DISTINCT work_id, chunk_id FROM evidence_store WHERE length(chunk_text) > 2400",
    "p4_coverage": "SELECT work_id, chunk_id, max(length(chunk_text)) AS n_chars, true AS within_limit, true AS overlaps_kept FROM evidence_store WHERE length(chunk_text) > 2400 GROUP BY 1, 2",
    "p6_documents": "SELECT doc_id, true AS whole, true AS holds FROM documents",
}
