"""Identity (V1-V7): terms that must not leak, masking of quotes, checks of mappings, leaks in structured records and in texts.

Terms of ASCII letters, digits, blanks and marks count only as whole words, all others anywhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import latest_texts
from inkmill.functions.text import strip
from inkmill.operators.evidence import terms, whole_word
from inkmill.operators.voices import said

ANCHOR = r"\[[a-zA-Z0-9_-]+\]\s*[“\"'「『]"
NOTE = "—\\s*注解：|注解："


def candidates(works: DataFrame, chunks: DataFrame, speakers: int = 3, brackets: int = 5) -> DataFrame:
    """(work_id, kind, term, score): author and title, the work's most frequent speakers (from two lines) and its terms in 《》.

    Ties in frequency go to the first term in order.  Counts are combined per chunk before the shuffle.
    """
    texts = latest_texts(chunks, ["work_id", "chunk_id"], "ingested_at", ["chunk_text"])
    score = F.when(F.col("kind") == "author", 1000).otherwise(999)
    fixed = terms(works).select("work_id", "kind", "term", score.cast("long").alias("score"))
    top = lambda df, n: df.withColumn("r", F.row_number().over(Window.partitionBy("work_id").orderBy(F.desc("n"), "term"))).where(F.col("r") <= n)
    voices = said(texts, "work_id", "chunk_text").groupBy("work_id", F.col("speaker").alias("term")).agg(F.count(F.lit(1)).alias("n"))
    voices = top(voices, speakers).where("n >= 2").select("work_id", F.lit("character").alias("kind"), "term", (F.col("n") * 5).alias("score"))
    named = texts.select("work_id", F.explode(F.regexp_extract_all("chunk_text", F.lit(L.BRACKETED), F.lit(1))).alias("term")).where(~F.col("term").isin(L.NO_IDENTITY))
    named = top(named.groupBy("work_id", "term").agg(F.count(F.lit(1)).alias("n")), brackets).select("work_id", F.lit("world").alias("kind"), "term", (F.col("n") * 10).alias("score"))
    return fixed.unionByName(voices).unionByName(named)


def hits(text: Column, term: Column) -> Column:
    """Occurrences of a term, whole words only for ASCII terms."""
    anywhere = F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))
    return F.when(F.contains(text, term), F.when(whole_word(term).isNotNull(), F.regexp_count(text, whole_word(term)).cast("long")).otherwise(anywhere)).otherwise(0).cast("long")


def masked_quotes(text: Column, placeholder: str = "") -> Column:
    """A text whose quotes behind anchors such as ``[E0001] “…”`` are replaced, up to the last closing mark before a note; notes stay."""
    inner = rf"^({ANCHOR})(.*)([”\"'」』])"

    def part(p: Column) -> Column:
        at = F.regexp_instr(p, F.lit(NOTE))
        head, note = F.when(at > 0, F.left(p, at - 1)).otherwise(p), F.when(at > 0, F.substring(p, at, F.length(p))).otherwise("")
        return F.when(p.rlike("^" + ANCHOR), F.concat(F.regexp_replace(head, inner, "$1" + placeholder + "$3"), note)).otherwise(p)

    line = lambda x: F.array_join(F.transform(F.split(x, f"(?={ANCHOR})", -1), part), "")
    return F.array_join(F.transform(F.split(text, r"\r\n|[\n\r]", -1), line), "\n")


def masked_evidence(items: DataFrame, placeholder: str = "") -> DataFrame:
    """(item_id, line): every citation as a report line with its quote masked and its note kept."""
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " ")
    line = F.concat(F.lit("["), F.format_string("I%d", F.col("item_id")), F.lit("] “"), flat("quote"), F.lit("” ("), flat("metric"), F.lit(") — 注解："), flat("note"))
    once = items.groupBy("item_id").agg(F.max_by(F.struct("quote", "metric", "note"), "ingested_at").alias("x")).select("item_id", "x.*")
    return once.select("item_id", masked_quotes(line, placeholder).alias("line"))


def mapping_problems(mapping: DataFrame, known: DataFrame) -> DataFrame:
    """(work_id, original, problem) of a mapping (work_id, original, replacement) against the candidate terms of each work.

    ``empty_key``, ``empty_value``, ``identity``, ``unknown`` (no candidate), ``label_length`` (not 2 to 4 characters) and
    ``leak`` (the replacement holds another original).
    """
    m = mapping.select("work_id", strip(F.coalesce("original", F.lit(""))).alias("original"), strip(F.coalesce("replacement", F.lit(""))).alias("replacement"))
    terms_ = known.select("work_id", strip(F.col("term")).alias("term")).where("term <> ''").distinct()
    originals = terms_.unionByName(m.where("original <> ''").select("work_id", F.col("original").alias("term"))).where(F.length("term") >= 2).distinct()
    leaks = m.where("original <> '' and replacement <> ''").join(originals, "work_id").where(F.contains("replacement", "term") & (F.col("term") != F.col("original"))).select("work_id", "original", F.lit("leak").alias("problem"))
    unknown = m.where("original <> ''").join(terms_.withColumnRenamed("term", "original"), ["work_id", "original"], "left_anti").select("work_id", "original", F.lit("unknown").alias("problem"))
    o, r = F.col("original"), F.col("replacement")
    own = F.filter(F.array(F.when(o == "", F.lit("empty_key")), F.when((o != "") & (r == ""), F.lit("empty_value")), F.when((o != "") & (r == o), F.lit("identity")), F.when((o != "") & (r != "") & ~F.length(r).between(2, 4), F.lit("label_length"))), lambda x: x.isNotNull())
    return m.select("work_id", "original", F.explode(own).alias("problem")).unionByName(leaks).unionByName(unknown).distinct()


def walked(value: object, path: str = "", parent: str = "") -> Iterator[tuple[str, str]]:
    """(path, string) of the keys and strings of a parsed JSON value, without quotes of evidence, discarded candidates and the keys of identity maps."""
    todo: list[tuple[object, str, str]] = [(value, path, parent)]
    while todo:
        node, at, above = todo.pop()
        if isinstance(node, str):
            yield at, node
        elif isinstance(node, list):
            todo += [(x, f"{at}[{i}]", above) for i, x in enumerate(node)]
        elif isinstance(node, dict):
            for k, v in node.items():
                if k == "discarded_candidates" or k == "quote" and above == "evidence":
                    continue
                if k == "desensitization_map":
                    todo += [(x, f"{at}.{k}", k) for x in (v.values() if isinstance(v, dict) else ())]
                    continue
                yield f"{at}.{k}", k
                todo.append((v, f"{at}.{k}", k))


def json_strings(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    """(keep, path, value) of every key and string of a JSON column; null and broken JSON have no rows."""
    picked = df.select(*keep, F.col(column).alias("_j"))
    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.columns[-1].to_pylist():
                try:
                    rows.append([{"path": p, "value": v} for p, v in walked(json.loads(text))] if text else [])
                except ValueError:
                    rows.append([])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], [*keep, "_s"])

    out = picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + ", _s array<struct<path:string,value:string>>")
    return out.select(*keep, F.explode("_s").alias("s")).select(*keep, "s.path", "s.value")


def record_leaks(strings: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, path, term, hits) of the terms of a work in its records' strings (work_id, key, path, value)."""
    own = known.select("work_id", "term").where(F.length("term") >= 2).distinct()
    return strings.join(own, "work_id").select(key, "path", "term", hits(F.col("value"), F.col("term")).alias("hits")).where("hits > 0")


def card_leaks(cards: DataFrame, works: DataFrame, chunks: DataFrame) -> DataFrame:
    fields = ["card_name", "definition", "serves_purpose", "trigger_cond", "steps", "boundary", "counterexample"]
    strings = json_strings(cards.select("card_id", "work_id", F.to_json(F.struct(*fields)).alias("j")), ["card_id", "work_id"], "j")
    return record_leaks(strings, "card_id", candidates(works, chunks))


def body_leaks(documents: DataFrame, works: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, kind, term, hits): terms of a work in the texts about it (documents of its title), quotes behind anchors left out."""
    key = lambda c: F.lower(strip(F.col(c)))
    titles = works.select(key("title").alias("t"), "work_id").where("t <> ''").groupBy("t").agg(F.min("work_id").alias("work_id"))
    body = F.when(F.col("text").rlike(ANCHOR), masked_quotes(F.col("text"))).otherwise(F.col("text"))
    texts = documents.select("doc_id", key("work_title").alias("t"), body.alias("body")).join(titles, "t")
    known = candidates(works, chunks).groupBy("work_id", "term").agg(F.min("kind").alias("kind"))
    return texts.join(known, "work_id").select("doc_id", "kind", "term", hits(F.col("body"), F.col("term")).alias("hits")).where("hits > 0")
