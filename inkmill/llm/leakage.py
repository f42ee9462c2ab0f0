"""Evaluation texts leaking into training text (problem 7).

One Aho-Corasick automaton holds all grams of the normalised test passages (and, if asked for, of questions and
answers).  Every document is normalised to its letters and digits with the offset of each in the original, and scanned
once.  Hits are grouped by passage and diagonal.  A stretch of n letters of which one in ten is changed still holds
``n + 1 - gram * (1 + n // 10)`` unchanged grams, so diagonals with fewer hits (chance hits on stock phrases) hold no
leak and are left; all others are compared in full by one numpy gather inside the document.  The best-scoring stretch
(a changed character costs ``penalty`` matches) counts if it reaches the language's length or covers the passage, and
so does any window of that length with at most one letter in ten changed.

Guarantee: every stretch of the length asked for with at most one changed letter in ten is found; with more changes it
is found if enough grams are unchanged.  Stretches of neighbouring diagonals, as left by an inserted or dropped
character, are chained if they are at most ``gap`` letters apart and have at least ``link`` letters each.

Test passages of more than ``most_chars`` characters are searched in blocks of that size, one scan of the documents a
block.

Defined results: null and empty texts hold nothing; passages that are null or without letters or digits match nothing;
a passage shorter than the length for its language must be there in full; items that share a passage all count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, parts
from inkmill.functions.frames import Shared

from .chars import LIMIT

#: Characters of test passages that are shipped to every executor at once.
MOST_PASSAGE_CHARS = 20_000_000
LEAST = {"zh": 50, "en": 100}
GRAM = {"zh": 7, "en": 7}


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point -> normalised code point; 0: neither letter nor digit."""
    table = np.zeros(LIMIT + 1, np.uint32)
    for first, last in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x2F800)):
        table[first:last] = np.arange(first, last)
    for cp in [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, LIMIT)]:
        c = chr(cp)
        one = unicodedata.normalize("NFKC", c)
        one = (one if len(one) == 1 else c).lower()
        if one[0].isalnum():
            table[cp] = ord(one[0])
    return table


def fold(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised letters and digits, index of each in points)."""
    out = folding()[np.minimum(points, LIMIT)]
    kept = np.flatnonzero(out)
    return out[kept], kept


class Passages:
    """Distinct normalised passages, their (item, field) pairs, and the automaton over their grams."""

    def __init__(self, items: list[tuple[int, str, str, str]], least: dict[str, int], gram: dict[str, int]) -> None:
        by: dict[tuple[str, str], list[tuple[int, str]]] = {}
        for item, field, text, lang in items:
            letters, _ = fold(decode(pa.array([text or ""]))[0])
            if len(letters):
                zh = (letters >= 0x2E80).mean() > 0.5 if lang not in least else lang == "zh"
                by.setdefault((letters.astype("<u4").tobytes().decode("utf-32-le"), "zh" if zh else "en"), []).append((item, field))
        self.items = list(by.values())
        self.length = np.array([len(text) for text, _ in by], np.int64)
        self.least = np.minimum(np.array([least[lang] for _, lang in by], np.int64), self.length)
        self.gram = np.minimum(np.array([gram[lang] for _, lang in by], np.int64), self.length)
        self.hits = np.maximum(1, self.least + 1 - self.gram * (1 + self.least // 10))
        self.base = np.concatenate(([0], np.cumsum(self.length)))  # where each passage begins in the letters of all
        self.letters = np.frombuffer("".join(text for text, _ in by).encode("utf-32-le"), "<u4") if by else np.zeros(0, np.uint32)
        places: dict[str, list[tuple[int, int]]] = {}
        for i, ((text, _), k) in enumerate(zip(by, self.gram.tolist())):
            for at in range(len(text) - k + 1):
                places.setdefault(text[at : at + k], []).append((i, at + k - 1))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        first, flat = [0], []
        for n, (text, where) in enumerate(places.items()):
            self.automaton.add_word(text, n)
            flat += where
            first.append(len(flat))
        self.first, self.flat = np.array(first), np.array(flat, np.int64).reshape(-1, 2)
        if places:
            self.automaton.make_automaton()

    def search(self, points: np.ndarray, offsets: np.ndarray, penalty: int = 4, gap: int = 3, link: int = 12) -> list[tuple[int, int, int, int]]:
        """(row, passage, start, end) of the leaked stretches, 0-based half-open in the row's own code points."""
        if not len(self.items):
            return []
        letters, kept = fold(points)
        row = np.searchsorted(offsets, kept, "right") - 1
        # a zero between rows keeps matches inside their row
        breaks = np.flatnonzero(np.diff(row)) + 1
        letters, kept, row = (np.insert(x, breaks, fill) for x, fill in ((letters, 0), (kept, 0), (row, -1)))
        hits = np.array(list(self.automaton.iter(letters.tobytes().decode("utf-32-le"))), np.int64).reshape(-1, 2)
        if not len(hits):
            return []
        counts = self.first[hits[:, 1] + 1] - self.first[hits[:, 1]]
        which = np.repeat(self.first[hits[:, 1]] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        end = np.repeat(hits[:, 0], counts)
        passage, diagonal = self.flat[which, 0], end - self.flat[which, 1]
        edges = np.concatenate(([-1], np.flatnonzero(letters == 0), [len(letters)]))
        key = passage << 40 | diagonal + (1 << 20)
        order = np.argsort(key, kind="stable")  # the hits of one diagonal stay in order of their ends
        key, end = key[order], end[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.concatenate((begin, [len(key)])))
        enough = count >= self.hits[key[begin] >> 40]
        hit = np.repeat(enough, count)
        key, end = key[hit], end[hit]
        home = np.searchsorted(edges, end) - 1  # a diagonal that runs on into the next row is another one there
        begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (home[1:] != home[:-1])))[: len(key)])
        enough = np.diff(np.concatenate((begin, [len(key)]))) >= self.hits[key[begin] >> 40]
        begin = begin[enough]
        passage, diagonal, home = key[begin] >> 40, (key[begin] & (1 << 40) - 1) - (1 << 20), home[begin]
        if not len(passage):
            return []
        low, high = edges[home] + 1, edges[home + 1]
        found = [self.stretch(letters, *(x[a : a + 4000] for x in (passage, diagonal, low, high)), penalty) for a in range(0, len(passage), 4000)]
        i, j = (np.concatenate(x) for x in zip(*found))
        here = row[low]
        long_ = j - i >= self.least[passage]
        out = list(zip(here[long_], passage[long_], diagonal[long_] + i[long_], diagonal[long_] + j[long_]))
        # chain stretches that an inserted or dropped character set on neighbouring diagonals
        rest = np.flatnonzero(~long_ & (j - i >= link))
        rest = rest[np.lexsort((i[rest], passage[rest], here[rest]))]
        if len(rest) > 1:
            a, b = rest[:-1], rest[1:]
            linked = (here[a] == here[b]) & (passage[a] == passage[b]) & (np.abs(diagonal[a] - diagonal[b]) <= gap) & (i[b] - j[a] <= gap) & (j[b] > j[a])
            group = np.concatenate(([0], np.cumsum(~linked)))
            edge = np.concatenate(([0], np.flatnonzero(~linked) + 1))
            first, last = i[rest[edge]], np.maximum.reduceat(j[rest], edge)
            lead, tail = rest[edge], rest[np.concatenate((edge[1:], [len(rest)])) - 1]
            good = (last - first >= self.least[passage[lead]]) & (np.bincount(group) > 1)
            out += list(zip(here[lead[good]], passage[lead[good]], (diagonal[lead] + first)[good], (diagonal[tail] + last)[good]))
        return [(int(r), int(p), int(kept[s] - offsets[r]), int(kept[e - 1] - offsets[r] + 1)) for r, p, s, e in out]

    def stretch(self, letters: np.ndarray, passage: np.ndarray, diagonal: np.ndarray, low: np.ndarray, high: np.ndarray, penalty: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end (in the passage) of the best stretch of each diagonal within its row, letters ``low`` to ``high``."""
        length = self.length[passage]
        wide = int(length.max())
        step = np.arange(wide)
        place = diagonal[:, None] + step
        inside = (place >= low[:, None]) & (place < high[:, None]) & (step < length[:, None])
        mine = self.letters[np.minimum(self.base[passage][:, None] + step, len(self.letters) - 1)]
        same = inside & (letters[np.clip(place, 0, len(letters) - 1)] == mine)
        total = np.zeros((len(passage), wide + 1), np.int32)
        np.cumsum(np.where(same, 1, -penalty), axis=1, out=total[:, 1:])
        least = np.minimum.accumulate(total, axis=1)
        j = (total - least).argmax(axis=1)
        bottom = (total == np.take_along_axis(least, j[:, None], 1)) & (np.arange(wide + 1) <= j[:, None])
        i = wide - np.argmax(bottom[:, ::-1], axis=1)
        # changes that stand close together split the best stretch: a window of the least length with one in ten changed counts as well
        least = self.least[passage]
        wrong = np.concatenate((np.zeros((len(passage), 1), np.int32), np.cumsum(~same, axis=1, dtype=np.int32)), axis=1)
        start = np.arange(wide + 1)
        stop = start + least[:, None]
        held = (start >= (low - diagonal)[:, None]) & (stop <= np.minimum(length, high - diagonal)[:, None])
        changed = np.where(held, np.take_along_axis(wrong, np.minimum(stop, wide), 1) - wrong, wide + 1)
        first = changed.argmin(axis=1)
        better = (j - i < least) & (changed.min(axis=1) <= least // 10)
        return np.where(better, first, i), np.where(better, first + least, j)


def build(rows: list[tuple[int, str, str, str]], least: dict[str, int], gram: dict[str, int]) -> Passages:
    return Passages(rows, least, gram)


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", fields: tuple[str, ...] = ("text",), lang: str = "lang",
          least: dict[str, int] | None = None, gram: dict[str, int] | None = None, most_chars: int = MOST_PASSAGE_CHARS) -> DataFrame:
    """(doc, item, field, start_pos, end_pos) of every stretch of a test text found in a document; positions from 1, inclusive.

    ``fields`` are the columns of ``items`` to be sought, such as passage, question and answer; a text below the least
    length of its language, as most answers are, must be there in full.  The documents are scanned in place, nothing of
    them is shuffled.
    """
    least, gram = least or LEAST, gram or GRAM
    texts = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("t")) for f in fields])).alias("x")
    chosen = items.select(F.col(item).cast("long").alias("i"), F.coalesce(F.col(lang), F.lit("")).alias("l"), texts).select("i", "x.f", "x.t", "l").where("i is not null and t is not null").distinct()
    size = chosen.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = -(-size // most_chars) or 1
    picked = documents.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")

    def scan(rows: list[tuple[int, str, str, str]]) -> DataFrame:
        shared = Shared(documents.sparkSession, rows, partial(build, least=least, gram=gram))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            built = shared.get()
            for batch in batches:
                for part in parts(batch):
                    points, offsets = decode(part.column(1))
                    ids = part.column(0).to_pylist()
                    out = [(ids[r], i, f, s + 1, e) for r, p, s, e in built.search(points, offsets) for i, f in built.items[p]]
                    columns = zip(*out) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "field", "start_pos", "end_pos"])

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return picked.mapInArrow(run, "doc_id long, item_id long, field string, start_pos long, end_pos long")

    in_block = lambda b: chosen.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b) if blocks > 1 else chosen
    scans = [scan(sorted(tuple(r) for r in in_block(b).collect())) for b in range(blocks)]
    return reduce(DataFrame.unionByName, scans).distinct()
