"""Filling fixed-capacity containers with documents (problem 6): bin completion, branch and bound.

Sizes are token counts of a public tokenizer whose vocabulary file is a parameter; the driver reads it once and ships
its ranks (a fixed size).  Documents above the capacity are divided into full pieces and a rest.  Items are spread by a
hash over blocks of about ``block_items`` and each block is packed on its own: always around its largest item, the
undominated fillings of the room left are enumerated from large to small, those that waste more than the bound
allows are pruned, and the search steps back to the next-best filling when the waste of all bins so far shows that the
incumbent (best-fit decreasing at first) cannot be beaten.  Bins that are not full enough are opened again and their
items packed in a second round, so that the blocks cost next to no room.

The search takes exponential time in the worst case, so ``Search`` limits it: fillings kept per bin, nodes walked per
bin, steps per block.  Beyond a limit the best packing so far is used, which never has more bins than best-fit
decreasing.  ``EXACT`` has no limits: every block then gets as few bins as there can be.

Defined results: null and empty texts have no tokens and take part with size 0 in some container of their block;
equal texts are separate items; every document comes out exactly once, or in consecutive pieces if it was divided.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.frames import Shared, materialise

#: The vocabulary file where the session does not name one in spark.inkmill.tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The split pattern that goes with the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Search(NamedTuple):
    """Limits of the search; None: no limit.  ``steps`` is per bin of the first packing."""

    width: int | None = 4
    nodes: int | None = 300
    steps: int | None = 3


EXACT = Search(None, None, None)


def encoder(data: bytes):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=parse_ranks(data), special_tokens={})


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def tokenizer_path(spark: SparkSession, path: str | None) -> str:
    return path or spark.conf.get("spark.inkmill.tokenizer", None) or TOKENIZER


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """(key, n_tokens) per row; nulls count 0."""
    shared = Shared(df.sparkSession, Path(tokenizer_path(df.sparkSession, tokenizer)).read_bytes(), encoder)
    picked = df.select(key, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.get()
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    return picked.mapInArrow(run, f"`{key}` {picked.dtypes[0][1]}, n_tokens int")


class Room:
    """A multiset of sizes as counts, with a bit mask of the sizes present."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        for s in sizes:
            self.count[s] += 1
        self.mask = sum(1 << s for s in range(1, capacity + 1) if self.count[s])

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            self.mask &= ~(1 << s)

    def give(self, s: int) -> None:
        self.count[s] += 1
        self.mask |= 1 << s

    def largest(self, most: int) -> int:
        """The largest size present that is at most ``most``; 0 if there is none."""
        return (self.mask & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.mask & ((2 << most) - 2) else 0


def spread(sums: int, waste: int) -> int:
    """All sums (bits) raised by 1 to ``waste``."""
    out, width = sums << 1, 1
    while waste and width < waste:
        more = min(width, waste - width)
        out |= out << more
        width += more
    return out if waste else 0


def dominated(room: Room, chosen: tuple[int, ...], waste: int) -> bool:
    """Whether one larger item of ``room`` can take the place of some of the chosen ones, or be added, within the waste.

    An item of the same sum as two or more chosen ones dominates them too: the smaller ones are easier to place later.
    """
    if room.mask & ((1 << waste + 1) - 1):
        return True
    some = several = 0
    for s in chosen:
        several |= (some << s) | (several << s)
        some |= (1 << s) | several
    return bool(room.mask & (spread(some, waste) | several))


def fillings(room: Room, free: int, most_waste: int, width: int | None = None, nodes: int | None = None) -> list[tuple[int, ...]]:
    """The undominated fillings of ``free`` from sizes in ``room``, least waste first, large sizes first.

    Sizes are walked from large to small; a branch is left when what can still follow wastes more than ``most_waste``.
    With ``width`` only so many fillings are kept, with ``nodes`` only so many steps are walked.
    """
    found: list[tuple[int, int, tuple[int, ...]]] = []
    worst = most_waste
    left = nodes

    def keep(waste: int, chosen: tuple[int, ...]) -> None:
        nonlocal worst
        if waste <= worst and not dominated(room, chosen, waste):
            found.append((waste, len(chosen), chosen))
            if width and len(found) >= width:
                found.sort()
                del found[width:]
                worst = found[-1][0] - 1

    def walk(free: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal left
        if left is not None:
            left -= 1
        s = room.largest(min(free, top))
        if not s:
            keep(free, chosen)
        while s and worst >= 0 and (left is None or left > 0):
            room.take(s)
            if s == free:
                keep(0, (*chosen, s))
            elif room.largest(min(free - s, s)) or free - s <= worst:
                walk(free - s, s, (*chosen, s))
            room.give(s)
            s = room.largest(s - 1)

    walk(free, free, ())
    found.sort()
    return [f for _, _, f in found]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing, by bins of equal room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, []
    for s in sorted(sizes, reverse=True):
        above = mask >> s
        if above and s:
            room = s + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        elif s == 0 and bins:
            bins[0].append(0)
            continue
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        room -= s
        if room > 0:
            by_room[room].append(b)
            mask |= 1 << room
    return bins


def complete(sizes: list[int], capacity: int, search: Search = Search()) -> list[list[int]]:
    """Bins of sizes, each at most ``capacity``: bin completion with best-fit decreasing as first incumbent."""
    zeros = [s for s in sizes if s <= 0]
    sizes = [s for s in sizes if s > 0]
    total = sum(sizes)
    bound = -(-total // capacity)
    best = best_fit(sizes, capacity)
    steps = None if search.steps is None else search.steps * len(best) + 2000
    if len(best) > bound:
        room = Room(sizes, capacity)
        bins: list[list[int]] = []
        choices: list[list[tuple[int, ...]]] = []
        waste = 0
        allowed = (len(best) - 1) * capacity - total
        while steps != 0 and len(best) > bound:
            if steps is not None:
                steps -= 1
            if not room.mask:
                if len(bins) < len(best):
                    best = [list(b) for b in bins]
                    allowed = (len(best) - 1) * capacity - total
                options = []
            elif waste > allowed:
                options = []
            else:
                top = room.largest(capacity)
                room.take(top)
                options = [(top, *f) for f in fillings(room, capacity - top, min(capacity - top, allowed - waste), search.width, search.nodes)]
                room.give(top)
            choices.append(options)
            while choices and not choices[-1]:  # step back
                choices.pop()
                if bins:
                    for s in bins[-1]:
                        room.give(s)
                    waste -= capacity - sum(bins[-1])
                    bins.pop()
            if not choices:
                break
            chosen = list(choices[-1].pop(0))
            for s in chosen:
                room.take(s)
            bins.append(chosen)
            waste += capacity - sum(chosen)
    if zeros:
        best = best or [[]]
        best[0] = [*best[0], *zeros]
    return best


def pack_ids(ids: list, sizes: list[int], capacity: int, search: Search = Search()) -> list[list]:
    """The ids of each bin; among equal sizes ids are used in the order given."""
    by: dict[int, list] = {}
    for i, s in sorted(zip(ids, sizes), reverse=True):
        by.setdefault(s, []).append(i)
    return [[by[s].pop() for s in b] for b in complete(sizes, capacity, search)]


RESULT = "round int, block long, bin int, fill int, doc_id long, piece_no int, n_tokens int"


def _packer(capacity: int, round_: int, search: Search):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(frame["doc_id"].tolist(), frame["piece_no"].tolist(), frame["n_tokens"].tolist()))
        out = []
        for b, members in enumerate(pack_ids(rows, [r[2] for r in rows], capacity, search)):
            fill = sum(m[2] for m in members)
            out += [(round_, int(frame["block"].iloc[0]), b, fill, *m) for m in members]
        return pd.DataFrame(out, columns=["round", "block", "bin", "fill", "doc_id", "piece_no", "n_tokens"])

    return run


def containers(documents: DataFrame, capacity: int = 2048, tokenizer: str | None = None, block_items: int = 20_000, full: float = 0.999, search: Search = Search()) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens, fill): every piece in its container.

    Only (id, size) rows are shuffled.  A block holds about ``block_items`` items whatever the input, as ids are
    spread by a hash.  ``piece_no`` is 0 for an undivided document, else counts from 1; ``start_token`` counts from 0.
    """
    n = max(1, documents.count())
    blocks = -(-n // block_items)
    sizes = token_counts(documents.where("doc_id is not null"), "doc_id", "text", tokenizer)
    whole = F.floor(F.col("n_tokens") / capacity).cast("int")
    parts = F.when(F.col("n_tokens") <= capacity, F.array(F.struct(F.lit(0).alias("piece_no"), F.col("n_tokens").alias("n_tokens")))).otherwise(
        F.filter(
            F.transform(F.sequence(F.lit(1), whole + 1), lambda k: F.struct(k.alias("piece_no"), F.when(k <= whole, F.lit(capacity)).otherwise(F.col("n_tokens") - whole * capacity).alias("n_tokens"))),
            lambda p: p["n_tokens"] > 0,
        )
    )
    pieces = sizes.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.piece_no", "p.n_tokens")
    block = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(blocks)).alias("block")
    # as many partitions as blocks, so that small blocks with much work are not put into one task
    first = materialise(pieces.select(block, "doc_id", "piece_no", "n_tokens").repartition(2 * blocks, "block").groupBy("block").applyInPandas(_packer(capacity, 1, search), RESULT))
    shut = first.where(F.col("fill") >= full * capacity)
    again = first.where(F.col("fill") < full * capacity)
    left = -(-again.count() // block_items) or 1
    block = F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(2)), F.lit(left)).alias("block")
    second = again.select(block, "doc_id", "piece_no", "n_tokens").repartition(2 * left, "block").groupBy("block").applyInPandas(_packer(capacity, 2, search), RESULT)
    return shut.unionByName(second).select(
        F.concat_ws("-", "round", "block", "bin").alias("container_id"), "doc_id", "piece_no", (F.greatest(F.col("piece_no") - 1, F.lit(0)) * capacity).cast("int").alias("start_token"), "n_tokens", "fill"
    )
