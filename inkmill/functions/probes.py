"""Finding many short quotes in many long texts in one scan of the texts, without pairing them.

Every quote is known by its length, the hash of its first characters (6, 12 or 24 of them, as many as it has) and two
hashes of the whole.  A text's hashes at all positions come from prefix sums; positions whose first characters are
known are compared with the whole quotes by both hashes (128 bits).  Texts stay where they are and only finds are
emitted.  Quotes are shipped in blocks of at most ``most``, one scan of the texts a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, parts
from inkmill.functions.frames import Shared, materialise

SIZES = (6, 12, 24)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MOST = 2_000_000
BITS = 24


def scrambled(points: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = points.astype(np.uint64) + np.uint64(turn + 1) * np.uint64(0xA0761D6478BD642F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of all stretches of a sequence of code points: sums of scrambled points times powers, brought to one power."""

    def __init__(self, points: np.ndarray) -> None:
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for turn, base in enumerate(BASES):
                powers = np.multiply.accumulate(np.full(len(points) + 1, base, np.uint64))
                self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled(points, turn) * powers[:-1], dtype=np.uint64))))
                self.back.append(np.multiply.accumulate(np.full(len(points) + 1, pow(base, -1, 1 << 64), np.uint64)))

    def of(self, first: np.ndarray, size: np.ndarray | int, turn: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[turn][first + size] - self.sums[turn][first]) * self.back[turn][first]


def mixed(h: np.ndarray, group: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (group.view(np.uint64) * np.uint64(0x9FB21C651E98DF25))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


class Probes:
    """Quotes by the hash of their group and first characters."""

    def __init__(self, group: np.ndarray, points: np.ndarray, offsets: np.ndarray, key: np.ndarray) -> None:
        size = np.diff(offsets)
        sums = Sums(points)
        first = np.select([size >= s for s in reversed(SIZES)], list(reversed(SIZES)), 0)
        head = mixed(sums.of(offsets[:-1], first), group)
        order = np.argsort(head, kind="stable")
        order = order[first[order] > 0]
        self.head, self.first, self.size, self.key = head[order], first[order], size[order], key[order]
        self.whole = [sums.of(offsets[:-1], size, t)[order] for t in (0, 1)]
        self.used = [s for s in SIZES if (self.first == s).any()]
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[self.head >> np.uint64(64 - BITS)] = True

    def found(self, points: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, quote) of the quotes held by each row, each once."""
        n, sums = len(points), Sums(points)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        spread = group[row]
        got = []
        for s in self.used:
            at = np.arange(max(0, n - s + 1))
            head = mixed(sums.of(at, s), spread[: len(at)])
            keep = np.flatnonzero(self.bits[head >> np.uint64(64 - BITS)])
            low, high = (np.searchsorted(self.head, head[keep], side) for side in ("left", "right"))
            hits = high - low
            at = np.repeat(keep, hits)
            which = np.repeat(low - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(hits.sum()) if len(hits) else low
            fits = (self.first[which] == s) & (at + self.size[which] <= offsets[1:][row[at]])
            at, which = at[fits], which[fits]
            same = np.ones(len(at), bool)
            for t in (0, 1):
                same &= sums.of(at, self.size[which], t) == self.whole[t][which]
            got.append(np.unique(row[at[same]] * np.int64(len(self.head)) + which[same]))
        both = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
        return both // max(1, len(self.head)), both % max(1, len(self.head))


def build(value: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Probes:
    return Probes(*value)


def find_quotes(texts: DataFrame, keep: list[str], group: str, text: str, quotes: DataFrame, form: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = decode, most: int = MOST) -> DataFrame:
    """(keep, quote_key): which text of a group holds which quote of the same group.

    ``quotes`` has the columns ``g`` (group), ``q`` (quote, of at least six characters to be found) and ``quote_key``
    (long).  ``form`` turns texts and quotes into the code points that are compared.  Nulls are found nowhere.
    """
    spark = texts.sparkSession
    rows = materialise(quotes.select(F.xxhash64("g").alias("g"), "q", F.col("quote_key").cast("long").alias("quote_key")).where("q is not null").distinct())
    blocks = -(-rows.count() // most) or 1
    picked = texts.where(F.col(text).isNotNull() & F.col(group).isNotNull()).select(*keep, F.xxhash64(group).alias("_g"), F.col(text).alias("_t"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[: len(keep)])

    def scan(block: int) -> DataFrame:
        mine = rows.where(F.pmod(F.xxhash64("g", "q"), F.lit(blocks)) == block) if blocks > 1 else rows
        table = mine.toArrow()
        points, offsets = form(table["q"].combine_chunks()) if table.num_rows else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        shared = Shared(spark, (table["g"].to_numpy(), points, offsets, table["quote_key"].to_numpy()), build)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probes = shared.get()
            for batch in batches:
                for part in parts(batch):
                    points, offsets = form(part.columns[-1])
                    row, which = probes.found(points, offsets, part.columns[-2].to_numpy())
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in part.columns[: len(keep)]), pa.array(probes.key[which], pa.int64())], [*keep, "quote_key"])

        return picked.mapInArrow(run, f"{kinds}, quote_key long")

    return reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)])
