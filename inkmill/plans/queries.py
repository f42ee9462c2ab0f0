"""The registered queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.frames import materialise, table
from inkmill.operators import cards, compare, dialogue, evidence, fidelity, identity, noise, packed, ratios, report, structure, style, tokenizer, voices
from inkmill.plans import more_oracles, oracles


def per_document(operator):
    return lambda spark, directory: operator(table(spark, directory, "documents", spread=True), ["doc_id"], "text")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return packed.unpack(table(spark, directory, "writer_contract"), "contract_id", "enemy_clauses", pos="clause_pos", value="clause_text")


def noise_stats(spark: SparkSession, directory: str) -> DataFrame:
    return noise.noise_stats(table(spark, directory, "documents", spread=True), "doc_id", "text")


def keyed(operator):
    return lambda spark, directory: operator(table(spark, directory, "documents", spread=True), "doc_id", "text")


def tokens(operator):
    """An operator on tagged tokens, over the tokens that can be told without a dictionary."""
    return lambda spark, directory: operator(ratios.tagged_tokens(table(spark, directory, "documents", spread=True), ["doc_id"], "text"), "doc_id")


def over(operator, *tables: str):
    return lambda spark, directory: operator(*[table(spark, directory, t, spread=t == "evidence_store") for t in tables])


def copy_risk(spark: SparkSession, directory: str) -> DataFrame:
    trials = table(spark, directory, "documents", spread=True).where("doc_kind = 'trial'")
    return compare.copy_risk(trials, "doc_id", "text", table(spark, directory, "eval_items"), "text")


def copy_risk_books(spark: SparkSession, directory: str) -> DataFrame:
    trials = table(spark, directory, "documents", spread=True).where("doc_kind = 'trial'")
    return compare.corpus_copy_risk(trials, "doc_id", "text", table(spark, directory, "evidence_store", spread=True), "chunk_text")


def mad_bands(spark: SparkSession, directory: str) -> DataFrame:
    return compare.mad_bands(table(spark, directory, "documents"), "doc_kind", "n_chars")


def expanded(spark: SparkSession, directory: str) -> DataFrame:
    """Every card given the first three anchors of its work by id alone."""
    own, items, chunks = (table(spark, directory, t) for t in ("technique_card", "evidence_item", "evidence_store"))
    refs = own.select("card_id", F.explode(F.array(*[F.lit(f"E{n:04d}") for n in (1, 2, 3)])).alias("evidence_id"))
    return cards.expanded(own, refs, items, chunks)


def contract_fields(spark: SparkSession, directory: str) -> DataFrame:
    return cards.contract_fields(table(spark, directory, "writer_contract"), p3_found(spark, directory))


def longest_shared(spark: SparkSession, directory: str) -> DataFrame:
    trials = table(spark, directory, "documents", spread=True).where("doc_kind = 'trial'")
    return fidelity.longest_shared(trials, "doc_id", "text", table(spark, directory, "eval_items"), "text")


def verdicts(spark: SparkSession, directory: str) -> DataFrame:
    return fidelity.verdicts(*[table(spark, directory, t) for t in ("documents", "works", "technique_card", "evidence_store")], copy_risk(spark, directory))


def masked(spark: SparkSession, directory: str) -> DataFrame:
    """Sizes and hashes of the masked texts, so that both engines can be compared."""
    out = evidence.masked(table(spark, directory, "works"), table(spark, directory, "evidence_store", spread=True))
    return out.select("work_id", "chunk_id", F.length("masked").alias("n_chars"), F.md5("masked").alias("masked_md5"))


def sampled_texts(spark: SparkSession, directory: str) -> DataFrame:
    out = structure.sampled_texts(table(spark, directory, "chapters"), table(spark, directory, "evidence_store"))
    return out.select("work_id", F.length("sampled_text").alias("n_chars"), F.md5("sampled_text").alias("text_md5"))


def mapping_problems(spark: SparkSession, directory: str) -> DataFrame:
    """A mapping made by rule from the candidates, with faults of every kind."""
    works = table(spark, directory, "works")
    known = materialise(identity.candidates(works, table(spark, directory, "evidence_store")))
    label = F.when(F.col("kind") == "author", F.lit("某作者")).when(F.col("kind") == "title", F.concat(F.lit("某"), F.col("term"))).when(F.col("kind") == "character", F.lit("某人")).otherwise(F.col("term"))
    made = known.select("work_id", F.col("term").alias("original"), label.alias("replacement"))
    faults = works.select("work_id", F.explode(F.array(F.struct(F.lit("未列之名").alias("original"), F.lit("").alias("replacement")), F.struct(F.lit(" ").alias("original"), F.lit("某物").alias("replacement")))).alias("x")).select("work_id", "x.*")
    return identity.mapping_problems(made.unionByName(faults), known)


def audited(spark: SparkSession, directory: str) -> DataFrame:
    """The same written claims for every document, held against its own measures."""
    docs = table(spark, directory, "documents", spread=True)
    claims = docs.select("doc_id", F.lit("平均句长约 20 字；短句率达 30.5%。\n- [E0001] “平均句长 99 字”\n破折号密度 1，总字符数为 1,000 字，见 {{total_chars}}。").alias("claim"))
    return report.audit(claims, "doc_id", "claim", report.metric_values(docs, "doc_id", "text"))


QUERIES = {
    "p3_found": p3_found,
    "noise_stats": noise_stats,
    **{f.__name__: per_document(f) for f in (style.style_core, style.sentence_stats, style.rhetoric, style.similes, style.description_mix, style.low_level, style.vocabulary_richness, style.top_words, ratios.style_labels)},
    "chapter_index": over(structure.chapter_index, "evidence_store"), "chunk_chapters": over(structure.chunk_chapters, "evidence_store", "chapters"), "volume_asof": over(structure.volume_asof, "chapters"),
    "fallback_chapters": keyed(structure.fallback_chapters), "reading_plan": over(structure.reading_plan, "chapters"), "fold_chunks": keyed(structure.fold_chunks),
    "imagery": keyed(tokenizer.imagery), "quotes": keyed(dialogue.quotes), "speakers": keyed(dialogue.speakers), "dialogue_functions": keyed(dialogue.dialogue_functions), "tag_counts": keyed(dialogue.tag_counts),
    "era_measures": over(compare.era_measures, "evidence_store"), "era_trends": over(compare.era_trends, "evidence_store"), "mad_bands": mad_bands, "copy_risk": copy_risk, "copy_risk_books": copy_risk_books, "scenes": keyed(compare.scenes),
    "evidence_verify": over(evidence.verify, "evidence_item", "evidence_store"), "work_codes": over(evidence.work_codes, "works"), "leak_scan": over(evidence.leak_scan, "works", "evidence_store"),
    "masked": masked, "anchors": over(evidence.anchors, "evidence_store"), "evidence_pool": over(evidence.evidence_pool, "evidence_store"),
    **{f.__name__: keyed(f) for f in (voices.fixed_phrases, voices.opening_words, voices.common_tags, voices.sample_quotes, voices.speaker_lists, voices.tag_frequencies, voices.tag_ratio, voices.unique_tags, voices.function_shares, voices.semantic_dimensions, voices.exemplars)},
    **{f.__name__: per_document(f) for f in (ratios.style_densities, ratios.style_markers, ratios.style_signals, ratios.scored_labels, ratios.deployment, ratios.low_level_ratios, ratios.special_systems, ratios.tagged_tokens)},
    "evidence_positions": over(cards.evidence_positions, "evidence_store"), "quote_eras": over(cards.quote_eras, "evidence_item", "evidence_store"), "verified_cards": over(cards.verified_cards, "technique_card", "evidence_item", "evidence_store"),
    "references": over(cards.references, "evidence_item", "evidence_store"), "expanded": expanded, "reinforced": over(cards.reinforced, "technique_card", "evidence_item"), "era_excerpts": over(cards.era_excerpts, "evidence_store"),
    "copy_references": over(cards.copy_references, "evidence_store"), "card_schema": over(cards.card_schema, "technique_card", "evidence_item"), "contract_fields": contract_fields,
    **{f.__name__: keyed(f) for f in (fidelity.scene_texts, fidelity.scene_checks, fidelity.scene_measures)}, **{f.__name__: over(f, "evidence_store") for f in (fidelity.era_windows, fidelity.era_matrix, fidelity.window_bands)},
    "deviations": over(fidelity.deviations, "documents", "works", "evidence_store"), "card_use": over(fidelity.card_use, "documents", "works", "technique_card", "evidence_store"), "verdicts": verdicts, "longest_shared": longest_shared,
    "candidates": over(identity.candidates, "works", "evidence_store"), "masked_evidence": lambda spark, directory: identity.masked_evidence(table(spark, directory, "evidence_item"), "某"), "mapping_problems": mapping_problems,
    "card_leaks": over(identity.card_leaks, "technique_card", "works", "evidence_store"), "body_leaks": over(identity.body_leaks, "documents", "works", "evidence_store"),
    "chapter_volumes": over(structure.chapter_volumes, "evidence_store"), "fallback_index": keyed(structure.fallback_index), **{f.__name__: over(f, "chapters") for f in (structure.plan_coverage, structure.plan_offsets, structure.plan_summary, structure.plan_ranges)}, "sampled_texts": sampled_texts,
    "noise_shares": keyed(noise.noise_shares), "work_noise": over(noise.work_noise, "evidence_store"),
    "style_measures": lambda spark, directory: ratios.measures(table(spark, directory, "documents", spread=True), ["doc_id"], "text").drop("total_chars"), "taboo_phrases": per_document(ratios.taboo_phrases),
    "chunk_eras": over(structure.chunk_eras, "evidence_store", "chapters"), "chunk_offsets": over(structure.chunk_offsets, "evidence_store"), "aliases": keyed(voices.aliases), "quote_chapters": over(voices.quote_chapters, "evidence_store", "chapters"),
    "answer_health": keyed(report.answer_health), "metric_values": keyed(report.metric_values), "metric_tokens": over(report.metric_tokens, "evidence_item"), "audited": audited,
    "pos_shares": tokens(ratios.pos_shares), "entities": tokens(ratios.entities),
}
ORACLES = {**oracles.ORACLES, **more_oracles.ORACLES}
__all__ = ["ORACLES", "QUERIES"]
