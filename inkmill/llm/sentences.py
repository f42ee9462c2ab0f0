"""Sentence boundaries across languages and scripts (problem 5).

Boundary rules are compiled into one finite transducer.  Its input letters are character classes (line break, each
kind of opening and closing mark, sentence mark, ellipsis, space, anything else), its states pair the innermost open
quotation or bracket with what stood last (nothing special, a sentence mark, an ellipsis).  A batch of texts is one
sequence of letters; equal-sized chunks of it are turned into state-transition functions (one next state per state),
composed by a parallel prefix scan, and replayed from their then known entry states.  Every step is a numpy gather
over all chunks at once, so one very long text is processed like many short ones.

What the states cannot know (abbreviations, decimals, initials, the words that name a speaker, spaces in Thai) is
decided at the few candidate positions by gathers on their neighbourhood.

Defined results: null, empty and blank texts have no sentences; a line break always ends one; an opening mark that is
never closed in its line opens nothing; a piece without letter or digit is no sentence.  Positions count code points
from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, parts

from .chars import BREAK, DIGIT, HAN, KANA, LETTER, LIMIT, LOWER, MARK, SPACE, THAI, look

# Pairs of marks; German low quotes are closed by either high mark.
PAIRS = ["“”", "„“", "«»", "「」", "『』", '""', "（）", "()", "《》", "【】"]
NESTED = ["“”", "「」", "（）", "()"]
BRACKETS = {"（）", "()", "《》", "【】"}
MARKS = "。！？!?।॥｡．؟"
ELLIPSIS = "…⋯"

# Abbreviations that never end a sentence, those that do so only before no digit, and German dates.
ABBREVIATIONS = "Dr Mr Mrs Ms Mme Mlle Mgr St Ste Prof Capt Gen Col Lt Sgt Rev Hon Sr Jr vs cf Hr Fr Hrn bzw usw ca им ул гг тыс млн डॉ श्री सं प्रो नं".split()
NUMBERED = "No Nr Nos Vol Ch Fig pp Art".split()
BEFORE_DAY = "Am am Vom vom Zum zum Bis bis Den den Dem dem Der der".split()
MONTHS = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()

SPEAKS = regex.compile(
    r"\s*(?:(?P<zh>[^，。！？：；、…—“”「」『』（）,.!?:;\s]{1,16}?(?:道|说|問|问|答|喊|叫|嚷|骂|喝|嘟囔|嘀咕|接口|开口)(?=[，。！？；…,.!?;]|\s*$|\s*\n))"
    r"|(?P<ja>と|って)"
    r"|(?P<hi>[^।!?“”\n]{1,40}?(?:ने (?:कहा|पूछा|बताया|जवाब दिया)|बोला|बोली|चिल्लाया)(?=[^\p{L}\p{M}]|$))"
    r"|(?P<en>\p{Lu}[\p{L}'’-]*\.?(?: \p{Lu}[\p{L}'’-]*\.?){0,3} (?:said|asked|replied|answered|cried|whispered|shouted|muttered|murmured|called|added|sagte|fragte|rief|antwortete|dit|demanda|répondit|сказал|сказала|спросил|спросила)\b))",
    regex.MULTILINE,
)


class Transducer:
    """The compiled rules: ``letters`` maps code points to input letters, ``step[letter, state]`` is the next state."""

    OTHER, LINE, BLANK, MARK, DOTS, FIRST = range(6)

    def __init__(self) -> None:
        nests = [(), *[(p,) for p in PAIRS], *[(p, p) for p in NESTED]]
        index = {n: i for i, n in enumerate(nests)}
        characters = sorted({c for p in PAIRS for c in p})
        self.letters = np.zeros(LIMIT + 1, np.uint8)
        flags = look(np.arange(LIMIT + 1))
        self.letters[(flags & SPACE) > 0] = self.BLANK
        self.letters[(flags & BREAK) > 0] = self.LINE
        self.letters[[ord(c) for c in MARKS]] = self.MARK
        self.letters[[ord(c) for c in ELLIPSIS]] = self.DOTS
        for i, c in enumerate(characters):
            self.letters[ord(c)] = self.FIRST + i
        self.nests, self.states = nests, len(nests) * 3
        self.quote = np.array([bool(n) and n[0] not in BRACKETS for n in nests])
        self.step = np.zeros((self.FIRST + len(characters), self.states), np.uint8)
        for n in nests:
            for last in range(3):
                state = index[n] * 3 + last
                self.step[self.OTHER, state] = index[n] * 3
                self.step[self.LINE, state] = 0
                self.step[self.BLANK, state] = state
                self.step[self.MARK, state] = index[n] * 3 + 1
                self.step[self.DOTS, state] = index[n] * 3 + 2
                for i, c in enumerate(characters):
                    self.step[self.FIRST + i, state] = index[self.turn(n, c)] * 3
        self.depth = np.arange(self.states) // 3
        self.last = np.arange(self.states) % 3

    @staticmethod
    def turn(n: tuple[str, ...], c: str) -> tuple[str, ...]:
        """The open marks after the mark ``c``; inside a pair only its own marks count."""
        if n and (c == n[-1][1] or n[-1] == "„“" and c == "”"):
            return n[:-1]
        if not n:
            return next(((p,) for p in PAIRS if p[0] == c), ())
        if n[-1] in NESTED and len(n) == 1 and c == n[-1][0]:
            return n + (n[-1],)
        return n

    def run(self, letters: np.ndarray, chunk: int = 64) -> np.ndarray:
        """The state before each letter, by prefix scan over the chunks' transition functions."""
        n = len(letters)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, self.BLANK, np.uint8)
        grid[:n] = letters
        grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
        function = np.tile(np.arange(self.states, dtype=np.uint8), (rows, 1))
        flat, wide = self.step.ravel(), self.states
        for column in grid:
            function = flat[column[:, None] * np.int32(wide) + function]
        shift = 1
        while shift < rows:  # after the loop function[i] is the composition of chunks 0..i
            later = function.copy()
            later[shift:] = np.take_along_axis(function[shift:], function[:-shift], axis=1)
            function, shift = later, shift * 2
        state = np.zeros(rows, np.uint8)
        state[1:] = function[:-1, 0]
        out = np.empty((chunk, rows), np.uint8)
        for i, column in enumerate(grid):
            out[i] = state
            state = flat[column * np.int32(wide) + state]
        return out.T.ravel()[:n]


_transducer: list[Transducer] = []


def transducer() -> Transducer:
    if not _transducer:
        _transducer.append(Transducer())
    return _transducer[0]


def _hash(word: str) -> int:
    h = 0
    for c in reversed(word):
        h = (h * 1000003 + ord(c)) & 0xFFFFFFFFFFFF
    return h


def _before(points: np.ndarray, word: np.ndarray, at: np.ndarray, most: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of the letters that end just before ``at`` (length most + 1: longer), and where they begin."""
    h, n, open_ = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(1, most + 2):
        i = at - k
        open_ &= (i >= 0) & word[np.maximum(i, 0)]
        h = np.where(open_, (h * 1000003 + points[np.maximum(i, 0)]) & 0xFFFFFFFFFFFF, h)
        n += open_
    return h, n, at - n


def _next(solid: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First index >= at that is solid (not blank); len(solid) if none."""
    where = np.flatnonzero(solid)
    i = np.searchsorted(where, at)
    return np.append(where, len(solid))[i]


def starts(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 0-based position) of the first non-space character of every sentence of a batch."""
    rows_n = len(offsets) - 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(points):
        return none
    t = transducer()
    points = np.insert(points, offsets[1:], 10)
    rows = np.repeat(np.arange(rows_n), np.diff(offsets) + 1)
    origin = offsets[:-1] + np.arange(rows_n)
    flags = look(points)
    letters = t.letters[np.minimum(points, LIMIT)]
    n = len(points)

    # full stops are marks only where the neighbourhood lets them be
    dot = np.flatnonzero(points == 46)
    if len(dot):
        before, after = points[np.maximum(dot - 1, 0)], points[np.minimum(dot + 1, n - 1)]
        dots = (before == 46) & (dot > 0) | (after == 46)
        word = (flags & (LETTER | MARK)) > 0
        h, length, begin = _before(points, word, dot)
        ahead = _next((flags & SPACE) == 0, dot + 1)
        line = _next((flags & BREAK) > 0, dot + 1)
        ahead = np.where(ahead < line, ahead, n)
        follows = np.append(flags, 0)[np.minimum(ahead, n)]
        east = (flags[np.maximum(dot - 1, 0)] & (HAN | KANA)) > 0
        spaced = (flags[np.minimum(dot + 1, n - 1)] & SPACE) > 0
        closer = np.isin(after, [0x201D, 0x201C, 0x00BB, 0x300D, 0x300F, 34, 41, 0xFF09, 0x2019])
        earlier = points[np.maximum(begin - 1, 0)]
        clock = (length == 1) & (earlier == 46) & np.isin(points[np.maximum(dot - 1, 0)], [109, 77]) & np.isin(points[np.maximum(dot - 3, 0)], [97, 112, 65, 80])
        short = (length == 1) & ~clock & ~east
        known = np.isin(h, [_hash(w) for w in ABBREVIATIONS]) & (length <= 6)
        numbered = np.isin(h, [_hash(w) for w in NUMBERED]) & ((follows & DIGIT) > 0)
        digits = (flags & DIGIT) > 0
        _, count, first = _before(points, digits, dot, 3)
        h2, l2, _ = _before(points, word, np.maximum(first - 1, 0), 6)
        day = (count >= 1) & (count <= 2) & np.isin(h2, [_hash(w) for w in BEFORE_DAY]) & (l2 > 0) & ((follows & LETTER) > 0)
        good = ~dots & np.where(east, (flags[np.minimum(dot + 1, n - 1)] & DIGIT) == 0, (spaced | closer) & ((follows & LOWER) == 0) & ~short & ~known & ~numbered & ~day)
        letters[dot[good]] = t.MARK
        letters[dot[dots]] = t.DOTS

    # only letters other than "anything else" and the first of each run of it can change the state
    keep = (letters != t.OTHER) | np.concatenate(([True], letters[:-1] != t.OTHER))
    spots = np.flatnonzero(keep)
    events = letters[spots]
    line = np.cumsum(events == t.LINE) - (events == t.LINE)
    todo = np.arange(len(events))
    while True:  # an opening mark that its line never closes is no mark; each round takes one from each such line, and only these go on
        part = events[todo]
        state = t.run(part)
        ends = np.flatnonzero((part == t.LINE) & (t.depth[state] > 0))
        if not len(ends):
            break
        opened = np.flatnonzero((t.depth[state] == 0) & (t.depth[t.step[part, state]] > 0))
        events[todo[np.unique(opened[np.searchsorted(opened, ends) - 1])]] = t.OTHER
        todo = todo[np.isin(line[todo], line[todo[ends]])]
    state = t.run(events)
    after_state = t.step[events, state]
    outside = t.depth[state] == 0

    solid = (flags & SPACE) == 0
    cut = np.zeros(n + 1, bool)  # cut[i]: a sentence ends before i
    mark = spots[(events == t.MARK) & outside]
    if len(mark):
        following = letters[np.minimum(mark + 1, n - 1)]
        run_on = (following == t.MARK) | (following == t.DOTS)
        ahead = np.minimum(_next(solid, mark + 1), n - 1)
        small = (flags[ahead] & LOWER) > 0
        glued = ~np.isin(points[mark], [0x3002, 0xFF01, 0xFF1F, 0x0964, 0x0965, 0xFF61, 0xFF0E]) & (ahead == mark + 1) & ((flags[ahead] & (LETTER | DIGIT)) > 0) & ((flags[ahead] & (HAN | KANA | THAI)) == 0) & ((flags[np.maximum(mark - 1, 0)] & (HAN | KANA)) == 0)
        cut[mark[~run_on & ~small & ~glued] + 1] = True
        tail = mark[run_on]
        if len(tail):  # a mark followed by an ellipsis: the run ends behind the last of them
            stop = _next((letters != t.MARK) & (letters != t.DOTS), tail + 1)
            cut[np.minimum(stop, n)] = True

    closed = ~outside & (t.depth[after_state] == 0) & (events != t.LINE) & (t.last[state] > 0) & t.quote[t.depth[state]]
    close = spots[closed]
    if len(close):
        ahead = np.minimum(_next(solid, close + 1), n - 1)
        line = _next((flags & BREAK) > 0, close + 1)
        inside = ahead < line
        joined = inside & (np.isin(points[ahead], [ord(c) for c in "，,、；;：:—–-)）"]) | (flags[ahead] & LOWER > 0) | (letters[ahead] == t.MARK) | (letters[ahead] == t.DOTS))
        asks = np.flatnonzero(inside & ~joined & ((flags[ahead] & (LETTER | MARK)) > 0))
        text = points.astype("<u4").tobytes().decode("utf-32-le") if len(asks) else ""
        match = SPEAKS.match
        for i, at in zip(asks.tolist(), (close[asks] + 1).tolist()):
            if match(text, at):
                joined[i] = True
        cut[close[~joined] + 1] = True

    thai = (flags & THAI) > 0
    gap = np.flatnonzero((letters == t.BLANK) & solid[np.maximum(np.arange(n) - 1, 0)])
    if len(gap) and thai.any():
        ahead = np.minimum(_next(solid, gap), n - 1)
        gap = gap[thai[np.maximum(gap - 1, 0)] & thai[ahead] & ((flags[ahead] & LETTER) > 0)]
        at = np.searchsorted(spots, gap)
        cut[gap[t.depth[state[at]] == 0]] = True

    cut[1:] |= (flags & BREAK) > 0
    segment = np.cumsum(cut[:n])
    shown = np.flatnonzero(solid)
    if not len(shown):
        return none
    seg = segment[shown]
    first = shown[np.concatenate(([True], seg[1:] != seg[:-1]))]
    worded = np.zeros(segment[-1] + 1, bool)
    worded[segment[(flags & (LETTER | DIGIT)) > 0]] = True
    first = first[worded[segment[first]]]
    return rows[first], first - origin[rows[first]]


def starts_array(column: pa.Array) -> pa.Array:
    """list<int32> of 1-based sentence starts per text."""
    points, offsets = decode(column)
    rows, at = starts(points, offsets)
    marks = np.searchsorted(rows, np.arange(len(column) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array((at + 1).astype(np.int32)))


def sentence_starts(df: DataFrame, column: str, keep: list[str], into: str = "starts") -> DataFrame:
    """``keep`` columns and the starts of the sentences of ``column``; row by row, no shuffle."""
    picked = df.select(*keep, F.col(column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], starts_array(part.columns[-1])], [*keep, into])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + f", `{into}` array<int>")


def sentences(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per sentence: ``keep`` columns, ``sent_no`` from 1, ``start_pos`` (1-based) and ``sentence``."""
    picked = df.select(*keep, F.col(column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = starts_array(part.columns[-1]).to_pylist()
                texts = [[x[a - 1 : b - 1].rstrip() for a, b in zip(s, [*s[1:], len(x) + 1])] if x else [] for x, s in zip(part.columns[-1].to_pylist(), found)]
                kinds = pa.list_(pa.int32()), pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kinds[0]), pa.array(texts, kinds[1])], [*keep, "_s", "_x"])

    out = picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + ", _s array<int>, _x array<string>")
    return out.select(*keep, F.posexplode(F.arrays_zip("_s", "_x"))).select(*keep, (F.col("pos") + 1).alias("sent_no"), F.col("col._s").cast("long").alias("start_pos"), F.col("col._x").alias("sentence"))
