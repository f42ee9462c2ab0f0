"""Splitting oversized texts at natural boundaries (problem 4): recursive bisection.

Every position of a text gets a strength (paragraph, line, sentence, clause, space, nothing; never before a combining
mark).  A text above the limit less the overlap is cut at the strongest position near its midpoint and both halves are
treated alike; afterwards every piece but the first is extended backwards over its predecessor by an overlap between
the two bounds, again at the strongest position.  Texts are split row by row; nothing is shuffled to split.

Defined results: null and empty texts give no pieces; texts up to the limit give one piece that is the text; a text
without any boundary is cut at its midpoint.  Positions count code points from 1, ends are inclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, parts
from inkmill.functions.frames import latest, latest_texts, materialise
from inkmill.functions.probes import find_quotes

from .chars import BREAK, MARK, SPACE, look
from .leakage import fold
from .lookalike_text import expanded_points
from .sentences import starts

NOTHING, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH, NEVER = 0, 1, 2, 3, 4, 5, -1


def strengths(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Strength of a cut before each position of one text, given its sentence starts."""
    flags = look(points)
    out = np.zeros(len(points) + 1, np.int8)
    space = flags & SPACE > 0
    broken = flags & BREAK > 0
    out[1:][space] = BLANK
    out[1:][np.isin(points, [ord(c) for c in "，,；;：:、،—…"])] = CLAUSE
    out[begins] = SENTENCE
    out[1:][broken] = LINE
    # a blank line: a break with only blanks between it and the break before
    at = np.flatnonzero(broken)
    if len(at) > 1:
        solid = np.concatenate(([0], np.cumsum(~space)))
        empty = (solid[at[1:]] == solid[at[:-1]]) & ~((at[1:] == at[:-1] + 1) & (points[at[1:]] == 10) & (points[at[:-1]] == 13))
        out[at[1:][empty] + 1] = PARAGRAPH
    pair = np.flatnonzero((points[:-1] == 13) & (points[1:] == 10)) + 1
    out[pair] = NEVER
    tied = (flags & MARK > 0) | (points == 0x200D) | ((points >= 0xFE00) & (points < 0xFE10)) | ((points >= 0x1F3FB) & (points < 0x1F400))
    out[:-1][tied] = NEVER
    out[1:][points == 0x200D] = NEVER
    return out


def strongest(strength: np.ndarray, low: int, high: int, middle: float) -> int:
    """The strongest cut position in [low, high], the one nearest to ``middle`` among equals."""
    part = strength[low : high + 1]
    best = np.flatnonzero(part == part.max())
    return low + int(best[np.argmin(np.abs(best + low - middle))])


def bisected(strength: np.ndarray, limit: int, low: int, high: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, 0-based half-open, at most ``limit`` long with their overlaps of low to high."""
    n, room = len(strength) - 1, limit - high
    if n <= limit:
        return [(0, n)]
    cuts, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            continue
        middle, reach = (a + b) / 2, max(1, (b - a) // 4)
        at = strongest(strength, int(middle - reach), int(middle + reach), middle)
        cuts.append(at)
        todo += [(a, at), (at, b)]
    cuts.sort()
    pieces = [(0, cuts[0])]
    for at, end in zip(cuts, [*cuts[1:], n]):
        pieces.append((strongest(strength, max(0, at - high), max(0, at - low), at - (low + high) / 2), end))
    return pieces


def pieces_of(points: np.ndarray, offsets: np.ndarray, limit: int, low: int, high: int) -> list[list[tuple[int, int]]]:
    """The pieces of every row of a batch."""
    row, at = starts(points, offsets)
    first = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b - a <= limit:
            out.append([(0, b - a)] if b > a else [])
        else:
            out.append(bisected(strengths(points[a:b], at[first[i] : first[i + 1]]), limit, low, high))
    return out


def split(df: DataFrame, text: str, keep: list[str], limit: int = 2400, low: int = 100, high: int = 200, with_text: bool = True) -> DataFrame:
    """One row per piece: ``keep``, piece_no (from 1), n_pieces, start_pos, end_pos and piece_text."""
    picked = df.select(*keep, F.col(text).alias("_text"))
    kind = pa.list_(pa.struct([("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("piece_text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                points, offsets = decode(part.columns[-1])
                found = pieces_of(points, offsets, limit, low, high)
                texts = part.columns[-1].to_pylist() if with_text else None
                rows = [[{"piece_no": k + 1, "start_pos": a + 1, "end_pos": b, "piece_text": texts[i][a:b] if with_text else None} for k, (a, b) in enumerate(p)] for i, p in enumerate(found)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, kind)], [*keep, "_p"])

    out = picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + ", _p array<struct<piece_no:int,start_pos:long,end_pos:long,piece_text:string>>")
    out = out.select(*keep, F.size("_p").alias("n_pieces"), F.explode("_p").alias("_p"))
    return out.select(*keep, "_p.piece_no", "n_pieces", "_p.start_pos", "_p.end_pos", *(["_p.piece_text"] if with_text else []))


def oversized(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.where(F.length("chunk_text") > limit).where("work_id is not null and chunk_id is not null")


def letters_of(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits of all rows without accents and in consistent form, their row offsets, and the index in ``points`` of each."""
    out, source = expanded_points(points)
    letters, kept = fold(out)
    where = source[kept]
    return letters, np.searchsorted(where, offsets), where


def letter_form(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return letters_of(*decode(column))[:2]


def nearest(text: np.ndarray, quote: np.ndarray, share: float = 0.5) -> int:
    """Where in ``text`` the quote stands with some of its letters changed, added or left out; -1 if under ``share`` of
    its three-letter groups are there, close to one diagonal."""
    n = len(quote) - 2
    if n < 6 or len(text) < 3:
        return -1
    code = lambda x: x[:-2].astype(np.int64) << 42 | x[1:-1].astype(np.int64) << 21 | x[2:]
    sought, spots = np.unique(code(quote), return_index=True)
    groups = code(text)
    at = np.minimum(np.searchsorted(sought, groups), len(sought) - 1)
    hit = np.flatnonzero(sought[at] == groups)
    if not len(hit):
        return -1
    diagonal = hit - spots[at[hit]] + len(quote)
    votes = np.bincount(diagonal, minlength=len(text) + 2 * len(quote))
    near = np.convolve(votes, np.ones(5, np.int64), "same")
    best = int(near.argmax())
    return max(0, best - len(quote)) if near[best] >= share * len(sought) else -1


def place(pieces: list[tuple[int, int]], a: int, b: int) -> int:
    """Number of the first piece that holds [a, b) whole, else of the first that holds most of it."""
    held = [min(b, y) - max(a, x) for x, y in pieces]
    return held.index(max(held)) + 1


PLACED = "item_id long, work_id string, chunk_id string, piece_no int, quote_pos long, near boolean"


def placed(pairs: DataFrame, texts: DataFrame, limit: int, low: int, high: int, most: int = 2000) -> DataFrame:
    """The piece of every (item_id, work_id, chunk_id, quote) whose chunk holds the quote, exactly or nearly.

    Items meet their chunk as lists of about ``most`` by hash, as many lists as a chunk needs.
    """
    keys = ["work_id", "chunk_id"]
    parts_of = pairs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n"))
    lists = pairs.join(parts_of, keys).groupBy(*keys, F.pmod(F.xxhash64("item_id"), F.col("_n")).alias("_s")).agg(F.collect_list(F.struct("item_id", "quote")).alias("items"))
    both = texts.select(*keys, "chunk_text").join(lists, keys).select(*keys, "chunk_text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for work, chunk, text, cited in zip(*(c.to_pylist() for c in batch.columns)):
                points, offsets = decode(pa.array([text]))
                pieces = pieces_of(points, offsets, limit, low, high)[0]
                letters, _, where = letters_of(points, offsets)
                whole = letters.astype("<u4").tobytes()
                quotes, edges = letter_form(pa.array([item["quote"] for item in cited], pa.string()))
                for k, item in enumerate(cited):
                    sought = quotes[edges[k] : edges[k + 1]]
                    at, near = found_at(whole, sought), False
                    if at < 0:
                        at, near = nearest(letters, sought), True
                    if at >= 0:
                        a, b = int(where[at]), int(where[min(at + len(sought), len(where)) - 1]) + 1
                        out.append((item["item_id"], work, chunk, place(pieces, a, b), a + 1, near))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "work_id", "chunk_id", "piece_no", "quote_pos", "near"])

    return both.mapInArrow(run, PLACED)


def found_at(whole: bytes, sought: np.ndarray) -> int:
    """Index of the first place of ``sought`` in the letters ``whole`` (four bytes each); -1 without one."""
    part = sought.astype("<u4").tobytes()
    at = whole.find(part) if part else -1
    while at >= 0 and at % 4:
        at = whole.find(part, at + 1)
    return at // 4 if at >= 0 else -1


def assign_pieces(chunks: DataFrame, items: DataFrame, limit: int = 2400, low: int = 100, high: int = 200) -> DataFrame:
    """(item_id, work_id, chunk_id, piece_no, quote_pos, match) of every item that cites an oversized chunk or no chunk of its work.

    The cited id is compared without case and outer space.  The quote is sought by its letters in consistent form,
    whatever its spacing, line ends, punctuation, accents and look-alike characters: in the cited chunk (match ``exact``), else in
    all chunks of the work by one scan, the first by ``seq`` (``moved``: chunk_id is the one found, as one piece if it
    is not oversized), else in the cited chunk with some letters different (``near``).  piece_no is the first piece that
    holds the quote whole, or most of it.  Items that cite an oversized chunk and whose quote is nowhere have a null
    piece_no; items that cite no chunk of their work appear only if their quote is found in an oversized one.
    """
    keys = ["work_id", "chunk_id"]
    texts = latest_texts(chunks.where("work_id is not null and chunk_id is not null"), keys, "ingested_at", ["seq", "chunk_text"])
    big = texts.where(F.length("chunk_text") > limit)
    ids = texts.select("work_id", "chunk_id", F.lower(F.trim("chunk_id")).alias("cited"), (F.length("chunk_text") > limit).alias("big"))
    cites = latest(items.where("item_id is not null"), ["item_id"], "ingested_at", ["work_id", "chunk_id", "quote"])
    cites = cites.select("item_id", "work_id", F.coalesce(F.lower(F.trim("chunk_id")), F.lit("")).alias("cited"), "quote").where("work_id is not null")
    wanted = materialise(cites.join(ids, ["work_id", "cited"], "left").where("chunk_id is null or big").drop("big", "cited"))
    here = materialise(placed(wanted.where("chunk_id is not null"), big, limit, low, high))
    open_ = wanted.join(here.where("not near"), ["item_id"], "left_anti").withColumn("quote_key", F.xxhash64("work_id", "quote"))
    found = find_quotes(texts, [*keys, "seq"], "work_id", "chunk_text", open_.select(F.col("work_id").alias("g"), F.col("quote").alias("q"), "quote_key"), letter_form)
    first = found.groupBy("work_id", "quote_key").agg(F.min(F.struct("seq", "chunk_id")).alias("f")).select("work_id", "quote_key", F.col("f.chunk_id").alias("chunk_id"))
    moved = placed(open_.drop("chunk_id").join(first, ["work_id", "quote_key"]).select("item_id", *keys, "quote"), texts, limit, low, high)
    moved = materialise(moved.join(big.select(*keys, F.lit(True).alias("big")), keys, "left").join(wanted.select("item_id", F.col("chunk_id").isNull().alias("lost")), "item_id").where("big or not lost"))
    near = here.where("near").join(moved, "item_id", "left_anti")
    out = [here.where("not near").withColumn("match", F.lit("exact")), moved.withColumn("match", F.lit("moved")), near.withColumn("match", F.lit("near"))]
    rows = reduce(DataFrame.unionByName, [x.select("item_id", *keys, "piece_no", "quote_pos", "match") for x in out])
    none = wanted.where("chunk_id is not null").join(rows, "item_id", "left_anti").select("item_id", *keys, F.lit(None).cast("int").alias("piece_no"), F.lit(None).cast("long").alias("quote_pos"), F.lit(None).cast("string").alias("match"))
    return rows.unionByName(none)
