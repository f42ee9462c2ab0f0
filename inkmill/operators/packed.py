"""Several values packed in one field (problem 3): dictionary-guided segmentation.

Two passes over the packed column.  The first cuts every field at its plain separators and counts the whole values;
those seen ``min_count`` times form the dictionary.  The second pass lets a multi-pattern automaton mark the known whole
values in each field, and a dynamic program chooses the cheapest cover of the field by values:

* a known value may hold separators of any kind, so it keeps them from cutting (``known; value`` stays whole);
* weak separators (commas, enumeration commas, unspaced slashes), which stand inside values as often as between them,
  cut only where known values meet on both sides;
* an unknown value reaches from one plain separator to the next.

What stands in quotation marks or brackets, is escaped, or is a value of a JSON list or a quoted value is not cut.

A dictionary of more than ``most_chars`` characters is searched in blocks of that size, one scan of the fields a block;
nothing is left out of it.

Defined results: a null, empty or blank field yields no rows; a field without separators yields one row; values keep
their order and repeated values keep their own positions; positions count from 1 and empty pieces take none.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.frames import Shared, materialise

PAIRS = {"“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "«": "»", "‘": "’"}
QUOTES = {"“": "”", "「": "」", "『": "』", '"': '"', "«": "»", "‘": "’"}
OPENS = {shut: opened for opened, shut in PAIRS.items()}
SEPARATORS = set(";；|｜\t\r\n")
WEAK = set(",，、/／")
SLASH = re.compile(r"\s+[/／]\s+")
COMMA = re.compile(r"\s*[,，]\s*")
BULLET = re.compile(r"[-–—*•·●▪◦‣]\s+|[•·●▪]\s*")
#: Characters that begin nothing but text.
PLAIN = re.compile(r"[^\s\\\d;；|｜,，、/／\"“「『（(\[【《〈«‘①-⑳]+")
MARKS = (
    ("paren", re.compile(r"[（(]\s*(\d{1,3})\s*[）)]\s*")),
    ("circle", re.compile(r"([①-⑳])\s*")),
    ("comma", re.compile(r"(?<!\d)(\d{1,3})、\s*")),
    ("dot", re.compile(r"(?<!\d)(\d{1,3})[.．](?!\d)\s*")),
    ("close", re.compile(r"(?<!\d)(\d{1,3})[)）]\s*")),
)
#: Costs of a known value, of an unknown one and of each of its characters, and of a cut at a weak separator.
KNOWN, UNKNOWN, LETTER, AT_WEAK = 1.0, 2.0, 0.5, 0.25
#: Characters of known values that are shipped to the executors at once.
MOST_CHARS = 10_000_000


def partners(text: str) -> dict[int, int]:
    """Index of each opening mark that is closed -> index of its closing mark; marks of one kind nest."""
    found: dict[int, int] = {}
    opened: defaultdict[str, list[int]] = defaultdict(list)
    for i, c in enumerate(text):
        if c in PAIRS:
            opened[c].append(i)
        elif c in OPENS and opened[OPENS[c]]:
            found[opened[OPENS[c]].pop()] = i
    return found


def number(style: str, mark: str) -> int:
    return ord(mark) - ord("①") + 1 if style == "circle" else int(mark)


def atoms(text: str) -> list[tuple[str, str]]:
    """The field as (kind, value) atoms; kind is "text", "cut" (separator), "mark" (numbering or bullet) or "weak" (weak separator)."""
    out: list[tuple[str, str]] = []
    plain: list[str] = []
    style, due, at, n, solid = "", 1, 0, len(text), False
    close = partners(text)

    def flush() -> None:
        nonlocal solid
        if plain:
            out.append(("text", "".join(plain)))
            plain.clear()
        solid = False

    while at < n:
        if solid and (m := PLAIN.match(text, at)):
            plain.append(m[0])
            at = m.end()
            continue
        c = text[at]
        fresh = not solid and (not out or out[-1][0] in ("cut", "mark"))
        if c == "\\" and at + 1 < n and (text[at + 1] in SEPARATORS or text[at + 1] in ",，/\\\"'"):
            plain.append(text[at + 1])
            at, solid = at + 2, True
            continue
        hit = None
        for kind, mark in MARKS:
            if style in ("", kind) and (m := mark.match(text, at)):
                if number(kind, m[1]) == due and (due > 1 or fresh):
                    hit = (kind, m)
                    break
        if hit:
            flush()
            style, due, at = hit[0], due + 1, hit[1].end()
            out.append(("mark", hit[1][0]))
            continue
        if fresh and (m := BULLET.match(text, at)):
            flush()
            out.append(("mark", m[0]))
            at = m.end()
            continue
        if c == '"' and fresh:
            end, value = at + 1, []
            while end < n:
                if text[end] == '"':
                    if text[end + 1 : end + 2] == '"':
                        value.append('"')
                        end += 2
                        continue
                    break
                value.append(text[end])
                end += 1
            if end < n and (end + 1 == n or text[end + 1] in SEPARATORS or text[end + 1] in ",， \t"):
                plain.clear()
                out.append(("text", "".join(value)))
                at = end + 1
                if m := COMMA.match(text, at):
                    out.append(("cut", m[0]))
                    at = m.end()
                continue
        if (end := close.get(at, -1)) > 0:
            plain.append(text[at : end + 1])
            at, solid = end + 1, True
            continue
        if c in SEPARATORS:
            flush()
            out.append(("cut", c))
            at += 1
            continue
        if c.isspace() and (m := SLASH.match(text, at)):
            flush()
            out.append(("cut", m[0]))
            at = m.end()
            continue
        if c in WEAK:
            flush()
            out.append(("weak", c))
            at += 1
            continue
        plain.append(c)
        solid = solid or not c.isspace()
        at += 1
    flush()
    return out


def bare(value: str) -> str:
    """A value without outer space, stray separators at its ends and quotes that enclose all of it."""
    while True:
        before = value
        value = value.strip().strip(";；|｜").strip()
        if len(value) > 1 and value[0] in QUOTES and value[-1] == QUOTES[value[0]]:
            if value[0] == '"':
                if '"' not in value[1:-1]:
                    value = value[1:-1]
            elif partners(value).get(0) == len(value) - 1:
                value = value[1:-1]
        if value == before:
            return value


def parsed(text: str) -> list[str] | None:
    """The values of a field that is a JSON list of scalars, else None."""
    if text.lstrip()[:1] != "[" or text.rstrip()[-1:] != "]":
        return None
    try:
        values = json.loads(text)
    except ValueError:
        return None
    if not isinstance(values, list) or any(isinstance(v, (list, dict)) for v in values):
        return None
    return [v for v in (str(x).strip() for x in values if x is not None) if v]


def matches(text: str | None, known: ahocorasick.Automaton | None) -> list[tuple[int, int]]:
    """The spans of known whole values in the atoms' text laid end to end."""
    if known is None or not text or not text.strip():
        return []
    flat = "".join(value for _, value in atoms(text.strip()))
    return [(end - len(v) + 1, end + 1) for end, v in known.iter(flat)]


def segment(text: str | None, known: ahocorasick.Automaton | list[tuple[int, int]] | None = None) -> list[str]:
    """The values of one packed field, in order; ``known`` is the automaton of whole values, or their spans in the field."""
    if not text or not text.strip():
        return []
    values = parsed(text)
    if values is not None:
        return values
    found = atoms(text.strip())
    n = len(found)
    if isinstance(known, ahocorasick.Automaton):
        known = matches(text, known)
    flat = "".join(value for _, value in found)
    places, at = [0], 0
    for _, value in found:
        at += len(value)
        places.append(at)
    # known values must begin and end with an atom, whatever blanks stand around them
    begins = {places[i] + len(v) - len(v.lstrip()): i for i, (kind, v) in enumerate(found) if kind == "text"}
    ends = {places[i + 1] - len(v) + len(v.rstrip()): i + 1 for i, (kind, v) in enumerate(found) if kind == "text"}
    spans: defaultdict[int, list[int]] = defaultdict(list)
    for a, b in known or []:
        if a in begins and b in ends:
            spans[ends[b]].append(begins[a])

    parted = lambda i: i in (0, n) or found[i - 1][0] in ("cut", "mark") or found[i][0] in ("cut", "mark")
    endless = (float("inf"), -1)
    # cheapest cover up to each atom border: reached with any value, reached with a known value, and begun behind a weak separator
    best, by_known, resumed = ([endless] * (n + 1) for _ in range(3))
    best[0], start = (0.0, -1), 0
    for end in range(1, n + 1):
        kind = found[end - 1][0]
        if kind in ("cut", "mark"):
            best[end], start = (best[end - 1][0], end - 1), end
            continue
        if kind == "weak":
            resumed[end] = (by_known[end - 1][0] + AT_WEAK, end - 1)
        for begin in spans[end]:
            before = min(best[begin][0] if parted(begin) else float("inf"), resumed[begin][0])
            by_known[end] = min(by_known[end], (before + KNOWN, begin))
        if parted(end):
            whole = (best[start][0] + UNKNOWN + LETTER * (places[end] - places[start]), start)
            best[end] = min(by_known[end], whole)
    out, end, weak = [], n, False
    while end > 0:
        if found[end - 1][0] in ("cut", "mark"):
            end -= 1
            continue
        begin = (by_known if weak else best)[end][1]
        out.append(bare(flat[places[begin] : places[end]]))
        weak = begin > 0 and resumed[begin][0] < (best[begin][0] if parted(begin) else float("inf"))
        end = begin - 1 if weak else begin
    return [v for v in reversed(out) if v]


def automaton(values: Iterable[str]) -> ahocorasick.Automaton | None:
    built = ahocorasick.Automaton()
    for v in values:
        built.add_word(v, v)
    if not len(built):
        return None
    built.make_automaton()
    return built


def dictionary(fields: DataFrame, column: str, min_count: int = 3) -> DataFrame:
    """(v): the whole values of the column seen ``min_count`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([segment(x) for x in batch.column(0).to_pylist()], pa.list_(pa.string()))], ["values"])

    pieces = fields.select(F.col(column).alias("f")).where(F.length(F.trim("f")) > 0).mapInArrow(run, "values array<string>")
    return pieces.select(F.explode("values").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("v")


def unpack(df: DataFrame, key: str, column: str, min_count: int = 3, pos: str = "pos", value: str = "value", most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per value of the packed ``column``: ``(key, pos, value)``; other columns of ``df`` are not needed.

    Rows delivered again with the same key and field count once.  Skew is harmless: cutting is row by row and only
    the distinct (key, field) pairs and the piece counts are shuffled, the latter pre-aggregated.
    """
    spark = df.sparkSession
    fields = df.select(F.col(key).alias("_k"), F.col(column).alias("_f")).where(F.length(F.trim("_f")) > 0).distinct()
    values = materialise(dictionary(fields, "_f", min_count))
    size = values.agg(F.sum(F.length("v")).alias("n")).first()["n"] or 0
    blocks = -(-size // most_chars) or 1
    kind = f"_k {dict(fields.dtypes)['_k']}, "

    def ship(block: int) -> Shared:
        mine = values.where(F.pmod(F.xxhash64("v"), F.lit(blocks)) == block) if blocks > 1 else values
        return Shared(spark, sorted(r["v"] for r in mine.collect()), automaton)

    def marked(known: Shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spans = [[{"a": a, "b": b} for a, b in matches(x, known.get())] for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["_k", "_f", "_s"])

        return fields.mapInArrow(run, kind + "_f string, _s array<struct<a:int,b:int>>").where(F.size("_s") > 0)

    def cut(known: Shared | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [known.get()] * batch.num_rows if known else [[(s["a"], s["b"]) for s in x or []] for x in batch.column(2).to_pylist()]
                lists = [segment(x, s) for x, s in zip(batch.column(1).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], ["_k", "_v"])

        return run

    if blocks == 1:
        out = fields.mapInArrow(cut(ship(0)), kind + "_v array<string>")
    else:
        spans = reduce(DataFrame.unionByName, [marked(ship(b)) for b in range(blocks)]).groupBy("_k", "_f").agg(F.flatten(F.collect_list("_s")).alias("_s"))
        out = fields.join(spans, ["_k", "_f"], "left").mapInArrow(cut(None), kind + "_v array<string>")
    return out.select("_k", F.posexplode("_v")).select(F.col("_k").alias(key), (F.col("pos") + 1).cast("int").alias(pos), F.col("col").alias(value))
