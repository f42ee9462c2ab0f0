"""Visually identical text with different characters (problem 2).

Arrow text is copied to one numpy array of code points per batch.  A lookup table built from Unicode data gives each
code point its expansion (invisible characters: none; spaces: one plain space; wide, narrow and compatibility forms,
radicals and precomposed letters: their parts; look-alike letters of other scripts: the Latin letter).  Expansion is a
gather with repeat offsets, marks are put in canonical order by one stable sort and composed in vectorised rounds.
Words that still hold a letter found only in Cyrillic or Greek get their look-alikes back from that script, which
depends on the folded word alone and therefore keeps equal-looking words equal.

Defined results: null stays null, an empty or wholly invisible text becomes empty; line breaks, tabs, case, accents,
punctuation, digits and Han characters are kept; runs of spaces keep their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, encode, parts
from inkmill.functions.frames import latest, materialise

from .lookalikes import LETTERS, RADICALS

LIMIT = 0x30000
KEEP = {"canonical", "<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>"}
HIDDEN = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10))


def _expand(cp: int, depth: int = 0) -> tuple[int, ...]:
    c = chr(cp)
    kind = unicodedata.category(c)
    if kind == "Cf" or cp in HIDDEN:
        return ()
    if kind == "Zs":
        return (32,)
    if c in LETTERS:
        return (ord(LETTERS[c]),)
    if c in RADICALS:
        return (ord(RADICALS[c]),)
    if 0xAC00 <= cp <= 0xD7A3 or depth > 8:
        return (cp,)
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return (cp,)
    tag = parts.pop(0) if parts[0].startswith("<") else "canonical"
    letter = kind[0] == "L" or kind == "Nl" or 0x2E80 <= cp <= 0x2FDF
    if tag not in KEEP or tag in ("<compat>", "<font>") and not letter:
        return (cp,)
    return tuple(x for p in parts for x in _expand(int(p, 16), depth + 1))


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    size, start, flat = np.ones(LIMIT, np.uint8), np.arange(LIMIT, dtype=np.int64), list(range(LIMIT))
    order = np.zeros(LIMIT, np.uint8)
    script = np.zeros(LIMIT, np.uint8)
    pairs: dict[int, int] = {}
    for cp in range(LIMIT):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7FF or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp < 0x2F800:
            continue
        c = chr(cp)
        order[cp] = unicodedata.combining(c)
        if 0x370 <= cp < 0x530 and unicodedata.category(c)[0] == "L":
            script[cp] = 1 if cp >= 0x400 else 2
        out = _expand(cp)
        if out != (cp,):
            size[cp], start[cp] = len(out), len(flat)
            flat.extend(out)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", c) == c:
            pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    folded = {c: LETTERS[c] for c in LETTERS}
    back = np.tile(np.arange(LIMIT, dtype=np.uint32), (3, 1))
    for c, latin in folded.items():
        which = script[ord(c)]
        if which and back[which, ord(latin)] == ord(latin):
            back[which, ord(latin)] = ord(c)
    keys = np.array(sorted(pairs), np.int64)
    return {"size": size, "start": start, "flat": np.array(flat, np.uint32), "order": order, "script": script, "back": back, "keys": keys, "made": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def _rescript(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    small = np.minimum(points, LIMIT - 1)
    script = t["script"][small]
    if not script.any():
        return points
    latin = (points < 0x250) & ((points | 32) >= 97) & ((points | 32) <= 122)
    inside = latin | (script > 0) | (t["order"][small] > 0)
    word = np.cumsum(np.concatenate(([True], (inside[1:] != inside[:-1]) | (rows[1:] != rows[:-1])))) - 1
    which = np.zeros(word[-1] + 1, np.uint8)
    np.maximum.at(which, word[script > 0], script[script > 0])
    return np.where(latin, t["back"][which[word], small], points)


def _compose(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.where(points < LIMIT, t["order"][np.minimum(points, LIMIT - 1)], 0)
    if order.any():
        at = np.arange(len(points))
        starter = np.maximum.accumulate(np.where((order == 0) | np.concatenate(([True], rows[1:] != rows[:-1])), at, 0))
        turn = np.lexsort((at, order, starter))
        points, order, starter = points[turn].copy(), order[turn], starter[turn]
        while True:
            at = np.arange(len(points))
            home = np.searchsorted(starter, starter, "left")
            previous = np.concatenate(([0], order[:-1]))
            free = (order > 0) & (home < at) & ((home == at - 1) | (previous < order))
            spot = np.flatnonzero(free)
            if not len(spot) or not len(t["keys"]):
                break
            key = points[home[spot]].astype(np.int64) << 21 | points[spot]
            found = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            good = t["keys"][found] == key
            spot, found = spot[good], found[good]
            if not len(spot):
                break
            _, first = np.unique(home[spot], return_index=True)
            spot, found = spot[first], found[first]
            points[home[spot]] = t["made"][found]
            stay = np.ones(len(points), bool)
            stay[spot] = False
            points, order, starter, rows = points[stay], order[stay], starter[stay], rows[stay]
    jamo = (points >= 0x1100) & (points < 0x1200)
    if jamo.any():
        for lead, first, last in (("L", 0x1161, 0x1175), ("LV", 0x11A8, 0x11C2)):
            a, b = points[:-1].astype(np.int64), points[1:].astype(np.int64)
            near = (rows[:-1] == rows[1:]) & (b >= first) & (b <= last)
            if lead == "L":
                hit = np.flatnonzero(near & (a >= 0x1100) & (a <= 0x1112))
                made = 0xAC00 + ((a[hit] - 0x1100) * 21 + b[hit] - 0x1161) * 28
            else:
                hit = np.flatnonzero(near & (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0))
                made = a[hit] + b[hit] - 0x11A7
            points = points.copy()
            points[hit] = made
            stay = np.ones(len(points), bool)
            stay[hit + 1] = False
            points, rows = points[stay], rows[stay]
    return points, rows


def expanded_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points expanded by the table, and the index of the character each comes from."""
    t = tables()
    inside = points < LIMIT
    small = np.where(inside, points, 0)
    size = np.where(inside, t["size"][small], np.where((points >= 0xE0000) & (points < 0xE0FFF), 0, 1)).astype(np.int64)
    ends = np.cumsum(size)
    source = np.repeat(np.arange(len(points)), size)
    within = np.arange(len(source)) - (ends - size)[source]
    return np.where(inside[source], t["flat"][np.where(inside, t["start"][small], 0)[source] + within], points[source]), source


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets in the consistent form."""
    t, n = tables(), len(offsets) - 1
    out, source = expanded_points(points)
    rows = np.repeat(np.arange(n), np.diff(offsets))[source]
    if len(out):
        out = _rescript(out.astype(np.uint32), rows, t)
        out, rows = _compose(out, rows, t)
    return out, np.searchsorted(rows, np.arange(n + 1))


def canonical_array(column: pa.Array) -> pa.Array:
    points, offsets = decode(column)
    out, marks = canonical_points(points, offsets)
    return encode(out, marks, np.asarray(column.is_null()) if column.null_count else None)


def canonical(df: DataFrame, column: str, into: str, keep: list[str]) -> DataFrame:
    """``keep`` columns of df and the consistent form of ``column``; row by row, no shuffle."""
    picked = df.select(*keep, F.col(column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], canonical_array(part.columns[-1]).cast(pa.string())], [*keep, into])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + f", `{into}` string")


def looks(df: DataFrame, key: str, group: str, column: str, order: str | None = None) -> DataFrame:
    """(id, g, look, raw): every row with the 128-bit hashes of what its text looks like and of its characters.

    The consistent form is computed once, before deliveries of one key are reduced to the latest by ``order``, so that
    only hashes are shuffled, and kept in a table for the joins that follow.  Nulls in the key, group or text and texts
    that show nothing are left out.
    """
    time = F.lit(0) if order is None else F.col(order)
    shown = canonical(df.where(F.col(key).isNotNull()).withColumn("_time", time), column, "_look", [key, group, "_time", column])
    digest = lambda c: F.unhex(F.md5(c))
    rows = shown.select(F.col(key).alias("id"), F.col(group).alias("g"), F.col("_time").alias("o"), F.when(F.length("_look") > 0, digest(F.col("_look"))).alias("look"), digest(F.col(column)).alias("raw"))
    return materialise(latest(rows, ["id"], "o", ["g", "look", "raw"]).where("g is not null and look is not null"))


def lookalike_pairs(df: DataFrame, key: str, group: str, column: str, order: str | None = None) -> DataFrame:
    """Pairs (item_a < item_b) of one ``group`` whose texts look the same but differ in their characters.

    Rows delivered again (same key) count once, the latest by ``order``.  The different spellings of one look
    are paired first, then each spelling is met with its rows, so copies of one spelling are never paired with each
    other and every row made is part of the result.  No group is gathered in one row; a hot look is split by the
    adaptive skew join.  Where pairs would be too many, ``look_classes`` has the same links in one row per text.
    """
    rows = looks(df, key, group, column, order)
    spellings = rows.groupBy("g", "look", "raw").agg(F.count(F.lit(1)).alias("n"))
    mixed = spellings.groupBy("g", "look").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("g", "look")
    spellings = materialise(spellings.join(mixed, ["g", "look"], "left_semi"))
    a, b = (spellings.select("g", "look", F.col("raw").alias(f"raw_{s}")) for s in "ab")
    both = a.join(b, ["g", "look"]).where("raw_a < raw_b")
    first = rows.select("g", "look", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    second = rows.select("g", "look", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    pairs = both.join(first, ["g", "look", "raw_a"]).select("g", "look", "raw_b", "x").join(second, ["g", "look", "raw_b"])
    return pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))


def look_classes(df: DataFrame, key: str, group: str, column: str, order: str | None = None) -> DataFrame:
    """One row per text: (key, group, class_id, n_links).

    Texts of one group that look the same share the class named by its smallest key; ``n_links`` counts those of them
    that differ in their characters.  Its size is that of the input, however many texts look alike.
    """
    rows = looks(df, key, group, column, order)
    spellings = rows.groupBy("g", "look", "raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    classes = spellings.groupBy("g", "look").agg(F.sum("n").alias("all"), F.min("m").alias("class_id"))
    links = spellings.join(classes, ["g", "look"]).select("g", "look", "raw", "class_id", (F.col("all") - F.col("n")).alias("n_links"))
    return rows.join(links, ["g", "look", "raw"]).select(F.col("id").alias(key), F.col("g").alias(group), "class_id", "n_links")
