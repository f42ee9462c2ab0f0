"""Subject areas of documents (problem 8).

Fit, over all documents, each text once: their terms (words, and character n-grams of Han text) are counted, and those kept
that come in bursts, as words of a subject do, or that the hand labels tie to a subject.  The documents become normalised
vectors of weighted terms.  Vectors are added up by their strongest term, bisecting k-means splits these sums into leaves,
and every document goes to the leaf nearest to it.  A leaf is labelled by its discriminative terms: the hand labels of the
documents that hold these terms vote, weighted by how much each term sets the leaf apart; leaves without a clear vote stand
for no subject.  The terms of the leaves are then sharpened on all sentences: each sentence goes to the leaf its other terms
speak for, and every term's weight per leaf is taken from these sentences.  The texts are read twice (counts, then the terms
of every sentence, which are kept in a table); the driver holds arrays of terms by leaves, never texts.

Apply, over all documents: every sentence goes to the leaf its terms speak for, and a document's mixture of leaves, added up by leaf label, gives its subjects: those with at least ``share`` of its
sentences, else ``general``.

Defined results: null, empty and blank texts are ``general``; ties between leaves of several subjects go to the subject
that more sentences of the document have, then to the first in alphabetical order; label rows repeated, re-cased or
padded count once, labels that are null or not in the list of subjects are left out, identical texts share their labels.
Without any labels every document is ``general``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions.codepoints import decode, parts
from inkmill.functions.frames import MOST_REPEATED, Shared, materialise

from .chars import HAN, LETTER, look
from .sentences import starts


def lower(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)


def grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, start, length) of every 2- to 4-gram of Han text and every word of 3 to 24 other letters, lower case."""
    points = lower(points)
    flags = look(points)
    han = (flags & HAN > 0) & (points < 0x10000)
    wide = points.astype(np.int64)
    codes, where, size = [], [], []
    n = len(points)
    code, ok, unit = wide - 0x3400 & 0x7FFF, han, wide - 0x3400 & 0x7FFF
    for k in (2, 3, 4):
        if n < k:
            continue
        code, ok = code[:-1] << 15 | unit[k - 1 :], ok[:-1] & han[k - 1 :]
        at = np.flatnonzero(ok)
        codes.append(code[at] << 2 | k - 1)
        where.append(at)
        size.append(np.full(len(at), k))
    letter = (flags & LETTER > 0) & ~han
    edge = np.flatnonzero(np.diff(np.concatenate(([0], letter.astype(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    fits = (b - a >= 3) & (b - a <= 24)
    a, b = a[fits], b[fits]
    h = np.full(len(a), 7, np.int64)
    for i in range(int((b - a).max()) if len(a) else 0):
        h = np.where(i < b - a, h * 1000003 + wide[np.minimum(a + i, n - 1)], h)
    codes.append(h << 2)
    where.append(a)
    size.append(b - a)
    return np.concatenate(codes), np.concatenate(where), np.concatenate(size)


def bisect(vectors: np.ndarray, leaves: int, rounds: int = 12, least: int = 6) -> np.ndarray:
    """Leaf number of each vector, which counts as its length says: the leaf of largest summed distance is split in two until there are enough."""
    leaf, length = np.zeros(len(vectors), np.int32), np.linalg.norm(vectors, axis=1)
    spread = {0: float(length.sum() - np.linalg.norm(vectors.sum(0)))}
    while len(spread) < leaves:
        worst = max(spread, key=lambda k: (spread[k], -k))
        if spread[worst] <= 0:
            break
        mine = np.flatnonzero(leaf == worst)
        x = vectors[mine]
        centre = x.sum(0)
        unit = 1 / (length[mine] + 1e-9)
        a = x[np.argmin(x @ centre * unit)]
        b = x[np.argmin(x @ a * unit)]
        a, b = a / (np.linalg.norm(a) + 1e-9), b / (np.linalg.norm(b) + 1e-9)
        side = None
        for _ in range(rounds):
            new = x @ b > x @ a
            if side is not None and (new == side).all():
                break
            side = new
            if not 0 < side.sum() < len(x):
                break
            a, b = x[~side].sum(0), x[side].sum(0)
            a, b = a / (np.linalg.norm(a) + 1e-9), b / (np.linalg.norm(b) + 1e-9)
        if side is None or min(max(half.sum(), length[mine][half].sum()) for half in (side, ~side)) < least:
            spread[worst] = 0.0
            continue
        name = len(spread)
        leaf[mine[side]] = name
        for k in (worst, name):
            spread[k] = float(length[leaf == k].sum() - np.linalg.norm(vectors[leaf == k].sum(0)))
    return leaf


class Model:
    """Terms with a weight per leaf, and the subject each leaf is labelled with (``len(subjects)``: none)."""

    def __init__(self, subjects: list[str], terms: list[str], weights: np.ndarray, labels: np.ndarray, numbers: np.ndarray | None = None) -> None:
        self.subjects, self.terms, self.weights, self.labels = subjects, terms, weights, labels
        self.numbers = np.arange(len(terms)) if numbers is None else numbers  # of the terms among those that were counted
        self.automaton = self.ranked = None
        order = np.argsort(labels, kind="stable")
        order = order[labels[order] < len(subjects)]
        self.order, self.named = order, np.unique(labels[order])
        self.edges = np.searchsorted(labels[order], self.named)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "automaton": None, "ranked": None}

    def prepare(self) -> Model:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.terms):
            self.automaton.add_word(t, i)
        if self.terms:
            self.automaton.make_automaton()
        self.length = np.array([len(t) for t in self.terms], np.int64)
        self.latin = np.array([not 0x3400 <= ord(t[0]) < 0x10000 for t in self.terms], bool)
        return self

    def hits(self, points: np.ndarray, offsets: np.ndarray, place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, term) of the terms found, once per sentence, in order; Latin words only whole."""
        small = lower(points)
        found = np.array(list(self.automaton.iter(small.tobytes().decode("utf-32-le"))), np.int64).reshape(-1, 2)
        end, term = found[:, 0], found[:, 1]
        first = end - self.length[term] + 1
        letter = np.concatenate((look(small) & LETTER > 0, [False]))
        whole = ~self.latin[term] | ~letter[end + 1] & ((first == 0) | ~letter[first - 1])
        first, end, term = first[whole], end[whole], term[whole]
        sentence = np.searchsorted(place, first, "right") - 1
        inside = (sentence >= 0) & (end < offsets[1:][row[np.maximum(sentence, 0)]])
        both = np.unique(sentence[inside] * len(self.terms) + term[inside])
        return both // len(self.terms), both % len(self.terms)

    def mixtures(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sentences per subject, sentences) of each row: leaves of the sentences, added up by label."""
        rows = len(offsets) - 1
        row, at = starts(points, offsets)
        total = np.bincount(row, minlength=rows)
        out = np.zeros((rows, len(self.subjects)))
        if not len(self.named) or not self.terms or not len(row):
            return out, total
        if self.automaton is None:
            self.prepare()
        sentence, term = self.hits(points, offsets, offsets[row] + at, row)
        if not len(sentence):
            return out, total
        return self.mixed(sentence, term, row, rows), total

    def mixed(self, sentence: np.ndarray, term: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Sentences per row and subject, from (sentence, term) in order of the sentences; ``row`` is that of each sentence."""
        out = np.zeros((rows, len(self.subjects)))
        if not len(self.named) or not len(sentence):
            return out
        if self.ranked is None:
            self.ranked = np.ascontiguousarray(self.weights[:, self.order])
        begin, leaf = added(sentence, term, self.ranked)
        spoken = sentence[begin]
        score = np.full((len(spoken), len(self.subjects)), -np.inf)
        for label, a, b in zip(self.named, self.edges, [*self.edges[1:], len(self.order)]):
            score[:, label] = reduce(np.maximum, leaf[:, a:b].T)  # the best leaf of each label
        best = score.max(1)
        told = best >= 1
        clear = (score >= best[:, None] - 0.7) & told[:, None]
        sure = clear.sum(1) == 1
        out += np.bincount(row[spoken[sure]] * out.shape[1] + score[sure].argmax(1), minlength=out.size).reshape(out.shape)
        open_ = np.flatnonzero(~sure & told)
        if len(open_):
            tie = np.where(clear[open_], out[row[spoken[open_]]] + 1e-3 * score[open_], -1)
            np.add.at(out, (row[spoken[open_]], tie.argmax(1)), 1)
        return out


def named_leaves(apart: np.ndarray, votes: np.ndarray, most: int = 40, lead: float = 0.25) -> np.ndarray:
    """Label of each leaf: the class its ``most`` discriminative terms vote for, the last class where no vote has ``lead``.

    ``apart[term, leaf]`` says how much a term sets a leaf apart, ``votes[term, class]`` which classes it is used in.
    """
    top = np.argsort(-apart, axis=0, kind="stable")[:most]
    weight = np.take_along_axis(apart, top, axis=0)
    vote = np.einsum("tl,tlc->lc", weight, votes[top]) / np.maximum(weight.sum(0), 1e-9)[:, None]
    first = vote[:, :-1].argmax(1)
    return np.where(vote[np.arange(len(vote)), first] >= lead, first, votes.shape[1] - 1)


def added(sentence: np.ndarray, term: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first pair, summed weights) of each sentence, for (sentence, term) pairs in order of the sentences.

    All first terms are added, then all second ones and so on: the weights are gathered a row per sentence, not per pair."""
    begin = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))) if len(sentence) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(sentence)))
    order = np.argsort(-size, kind="stable")
    at, size = begin[order], size[order]
    sums = weights[term[at]]
    for k, left in enumerate(np.cumsum(np.bincount(size)[::-1])[::-1][2:].tolist() if len(size) else [], 1):
        sums[:left] += weights[term[at[:left] + k]]
    out = np.empty_like(sums)
    out[order] = sums
    return begin, out


def led(sentence: np.ndarray, term: np.ndarray, live: np.ndarray, weights: np.ndarray, low: np.ndarray, block: int = 20_000) -> np.ndarray:
    """For each (sentence, term) pair, ordered by sentence, the leaf that the sentence's other terms speak for; the
    number of leaves if they speak for none.  ``live`` are the pairs with a weight; they are taken in blocks.

    ``low`` are the least weights of the terms.  A term that cannot take the lead from its sentence's first leaf, even if it
    adds nothing else to the second one, needs no comparison of all leaves."""
    leaves = weights.shape[1]
    out = np.full(len(sentence), leaves, np.int64)
    begin = np.flatnonzero(np.concatenate(([True], np.diff(sentence[live]) != 0))) if len(live) else np.zeros(0, np.int64)
    edges = np.append(begin, len(live))
    alone = np.full(int(sentence[-1]) + 1 if len(sentence) else 0, leaves, np.int64)
    for a in range(0, len(begin), block):
        b = min(a + block, len(begin))
        mine = live[edges[a] : edges[b]]
        t = term[mine]
        score = added(sentence[mine], t, weights)[1]
        each, first = np.arange(b - a), score.argmax(1)
        top = score[each, first]
        alone[sentence[live[begin[a:b]]]] = np.where(top > 1, first, leaves)
        score[each, first] = -np.inf
        second = score.max(1)
        score[each, first] = top
        size = np.diff(edges[a : b + 1])
        here = np.repeat(each, size)
        rest = top[here] - weights[t, first[here]]
        to = np.where(rest > 1, first[here], leaves)
        open_ = np.flatnonzero((rest <= second[here] - low[t] + 1e-3) & (top[here] - low[t] > 1 - 1e-3))
        if len(open_):
            full = score[here[open_]] - weights[t[open_]]
            best = full.argmax(1)
            to[open_] = np.where(full[np.arange(len(open_)), best] > 1, best, leaves)
        out[mine] = np.where((size > 1)[here], to, leaves)
    quiet = np.ones(len(sentence), bool)
    quiet[live] = False
    out[quiet] = alone[sentence[quiet]]
    return out


#: Features of the document vectors.
FEATURES = 3000


class Terms(NamedTuple):
    """The terms kept, by code, with occurrences, documents and hand labels (term by class); ``n`` texts in all, ``prior``
    labels of each class."""

    code: np.ndarray
    name: list[str]
    tf: np.ndarray
    df: np.ndarray
    votes: np.ndarray
    n: int
    prior: np.ndarray

    @property
    def floor(self) -> int:
        return least_documents(self.n)


def least_documents(n: int) -> int:
    """Documents that a term must be in, of ``n``."""
    return max(4, int(2e-4 * n))


def counted(points: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, list[str | None], np.ndarray, np.ndarray, np.ndarray]:
    """(code, word, occurrences, texts, marks of these) of each term of the texts; ``marks[text, class]``, words of Han have none."""
    code, where, size = grams(points)
    row = np.searchsorted(offsets, where, "right") - 1
    whole = where + size <= offsets[row + 1]
    code, where, size, row = code[whole], where[whole], size[whole], row[whole]
    order = np.argsort(code)
    code, row = code[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(code)))
    n = max(1, len(offsets) - 1)
    cell = np.sort(np.repeat(np.arange(len(first)), tf) * n + row)
    cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))] if len(cell) else cell
    t, r = cell // n, cell % n
    df = np.bincount(t, minlength=len(first))
    held = marks.any(1)[r]
    votes = np.zeros((len(first), marks.shape[1]))
    for c in range(marks.shape[1] if held.any() else 0):
        votes[:, c] = np.bincount(t[held], weights=marks[r[held], c], minlength=len(first))
    words: list[str | None] = [None] * len(first)
    small = lower(points)
    for i in np.flatnonzero(code[first] & 3 == 0).tolist():
        at = order[first[i]]
        words[i] = small[where[at] : where[at] + size[at]].tobytes().decode("utf-32-le")
    return code[first], words, tf, df, votes


def spelled(code: int, word: str | None) -> str:
    """The term of a code; those of Han hold their characters."""
    return word if word is not None else "".join(chr(0x3400 + (code >> 2 + 15 * i & 0x7FFF)) for i in range(code & 3, -1, -1))


def telling(tf: np.ndarray, df: np.ndarray, votes: np.ndarray, prior: np.ndarray, least: float = 0.25) -> np.ndarray:
    """Terms that come in bursts or that the hand labels tie to a subject (the last class is none)."""
    share = votes / prior + 0.3 / prior.mean()
    return (tf >= 1.05 * df) | ((share[:, :-1].max(1) >= least * share.sum(1)) & (votes.sum(1) >= 1))


class Block(NamedTuple):
    """Texts as (sentence, term) pairs, each once, in order; ``row`` is the text of each sentence, ``marks`` are its hand labels."""

    sentence: np.ndarray
    term: np.ndarray
    row: np.ndarray
    marks: np.ndarray

    def held(self, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, sentences) of the terms of each text."""
        cell, n = np.unique(self.row[self.sentence] * terms + self.term, return_counts=True)
        return cell // terms, cell % terms, n

    def vectors(self, column: np.ndarray, idf: np.ndarray, held: tuple | None = None) -> np.ndarray:
        row, term, n = held or self.held(len(column))
        at = column[term]
        used = at >= 0
        out = np.zeros((len(self.marks), len(idf)), np.float32)
        out[row[used], at[used]] = np.log1p(n[used]) * idf[at[used]]
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)


class Lookup:
    """Places of codes among ``codes``, which is sorted and has no repeats, by a table of hashes."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.bits = codes, max(10, (16 * len(codes)).bit_length())
        slot, own = self.slot(codes), np.arange(len(codes), dtype=np.int32)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.table[slot] = own
        self.table[slot[self.table[slot] != own]] = -2  # several codes: these are sought by bisection

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, place) of those that are there."""
        place = self.table[self.slot(codes)]
        several = np.flatnonzero(place == -2)
        place[several] = np.minimum(np.searchsorted(self.codes, codes[several]), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[place] == codes)  # an empty slot is that of no code, not of the last one either
        return known, place[known].astype(np.int64)


def pairs(points: np.ndarray, offsets: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, term, text of each sentence) of the texts, for the terms of ``lookup``; the pairs are in order."""
    row, at = starts(points, offsets)
    none = np.zeros(0, np.int64)
    if not len(lookup.codes) or not len(row):
        return none, none, row
    code, where, size = grams(points)
    known, term = lookup.find(code)
    where, size = where[known], size[known]
    sentence = np.searchsorted(offsets[row] + at, where, "right") - 1
    inside = (sentence >= 0) & (where + size <= offsets[1:][row[np.maximum(sentence, 0)]])
    both = np.sort(sentence[inside] * len(lookup.codes) + term[inside])
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both // len(lookup.codes), both % len(lookup.codes), row


Counts = list[tuple[np.ndarray, np.ndarray]]


def cell_sums(block: Block, column: np.ndarray, idf: np.ndarray) -> Counts:
    """Vectors added up by their strongest term."""
    x = block.vectors(column, idf)
    r, c = np.nonzero(x)
    return [(x.argmax(1)[r] * len(idf) + c, x[r, c])]


def leaf_counts(block: Block, column: np.ndarray, idf: np.ndarray, centres: np.ndarray | None, leaf: np.ndarray | None = None) -> Counts:
    """Documents by term and leaf, and by leaf; without ``leaf`` it is the nearest of ``centres``, the last one for none."""
    held = block.held(len(column))
    if leaf is None:
        near = block.vectors(column, idf, held) @ centres
        leaf = np.concatenate((near, np.full((len(near), 1), 1e-6, near.dtype)), axis=1).argmax(1)
        l = centres.shape[1] + 1
    else:
        l = int(leaf.max()) + 1
    row, term, _ = held
    return [(term * l + leaf[row], np.ones(len(row), np.float32)), (len(column) * l + leaf, np.ones(len(leaf), np.float32))]


def sentence_counts(block: Block, weights: np.ndarray, low: np.ndarray, named: np.ndarray, spoken: np.ndarray, l: int) -> Counts:
    """Terms by the leaf that the other terms of their sentence speak for, and these by leaf; the last one, ``l``, is none.

    ``weights`` are those of the leaves in ``spoken``, which have a label, ``low`` the least ones."""
    m = len(weights)
    to = np.append(spoken, l)[led(block.sentence, block.term, np.flatnonzero(named[block.term]), weights, low)]
    by = np.bincount(to, minlength=l + 1)
    return [(block.term * (l + 1) + to, np.ones(len(to), np.float32)), (m * (l + 1) + np.arange(l + 1), by.astype(np.float32))]


def summed(counts: Counts, size: int) -> np.ndarray:
    return np.bincount(np.concatenate([i for i, _ in counts]), weights=np.concatenate([v for _, v in counts]), minlength=size)


def trained(total: Callable[..., np.ndarray], terms: Terms, subjects: list[str], leaves: int, passes: int, whole: Block | None = None) -> Model:
    """The model; ``total(counts, size, *state)`` adds up ``counts(block, *state)`` over all blocks.  Where all texts are one
    block (``whole``), their vectors themselves are split into leaves."""
    m, n, k, df, floor = len(terms.code), terms.n, len(subjects) + 1, terms.df, terms.floor
    burst = np.argsort(-(terms.tf / df - 1) * np.sqrt(df), kind="stable")[:FEATURES]
    column = np.full(m, -1)
    column[burst] = np.arange(len(burst))
    idf = np.log(n / df[burst]).astype(np.float32)
    leaves = min(leaves, max(2, n // 8))
    if whole is not None:
        leaf = bisect(whole.vectors(column, idf), leaves)
        l = int(leaf.max()) + 1
        both = total(leaf_counts, (m + 1) * l, column, idf, None, leaf)
    else:
        sums = total(cell_sums, len(idf) ** 2, column, idf).astype(np.float32).reshape(len(idf), -1)
        sums = sums[sums.any(1)]
        leaf = bisect(sums, leaves)
        centres = np.stack([sums[leaf == i].sum(0) for i in range(int(leaf.max()) + 1)], axis=1)
        del sums
        centres /= np.linalg.norm(centres, axis=0) + 1e-9
        l = centres.shape[1] + 1
        both = total(leaf_counts, (m + 1) * l, column, idf, centres)

    # discriminative terms of the leaves, and the labels they vote for
    counts, size_of = both[: m * l].reshape(m, l), both[m * l :]
    weights = np.log((counts + df[:, None] / n) / (size_of + 1) / (df / n)[:, None])
    prior = terms.prior + 0.5
    votes = terms.votes / prior + 0.3 / prior.mean()
    votes /= votes.sum(1, keepdims=True)
    bursts = terms.tf >= 1.05 * df
    label = named_leaves(np.where((weights > 0.7) & bursts[:, None], counts * weights, 0), votes)
    home, spoken = np.eye(k)[label], np.flatnonzero(label < k - 1)
    if not len(spoken):
        return unfit(subjects)

    # terms per leaf by documents first, then by sentences
    base = home.T @ size_of + 1
    by_label = counts @ home / base * base.mean()  # as if every label had as many documents
    for turn in range(passes + 1):
        p = (by_label + 0.02) / (by_label.sum(1, keepdims=True) + 0.02 * k)
        named = (p[:, :-1].max(1) >= (0.4 if turn else 0.5)) & (by_label.sum(1) >= floor if turn else bursts)
        weights = np.where(named[:, None] & (label < k - 1), np.clip(weights, -2.0, 3.0), 0.0).astype(np.float32)
        if turn == passes:
            break
        heard = np.ascontiguousarray(weights[:, spoken])
        both = total(sentence_counts, (m + 1) * (l + 1), heard, heard.min(1), named, spoken, l)
        counts, size_of = both[: m * (l + 1)].reshape(m, l + 1), both[m * (l + 1) :] + 1.0
        common = counts.sum(1, keepdims=True) / size_of.sum() + 1e-9
        unled, counts, size_of = counts[:, l], counts[:, :l], size_of[:l]
        weights = np.log((counts + 30 * common) / (size_of + 30) / common)
        by_label = counts @ home
        by_label[:, -1] += unled
        base = np.maximum(home[:, :-1].T @ size_of, 1)
        by_label[:, :-1] *= base.mean() / base
    final = np.flatnonzero(named)
    names = [terms.name[i] for i in final]
    # of nested grams that always come together only the longest says anything of its own
    have = {t: i for i, t in enumerate(names)}
    drop = {have[t[a:b]] for i, t in enumerate(names) if t[0] >= "㐀" for a in range(len(t)) for b in range(a + 2, len(t) + 1) if b - a < len(t) and t[a:b] in have and df[final[have[t[a:b]]]] <= 1.15 * df[final[i]]}
    stay = [i for i in range(len(names)) if i not in drop]
    return Model(subjects, [names[i] for i in stay], weights[final[stay]], label, final[stay])


def fit(texts: list[str], labels: list[set[str]], subjects: list[str], other: str = "general", leaves: int = 60, passes: int = 2) -> Model:
    """The model from the texts given, in memory; texts without a hand label have an empty set."""
    subjects = [s for s in sorted(subjects) if s != other]
    index = {s: i for i, s in enumerate([*subjects, other])}
    points, offsets = decode(pa.array(texts, pa.string()))
    marks = np.zeros((len(texts), len(index)))
    for i, names in enumerate(labels):
        for s in names:
            marks[i, index[s]] = 1 / len(names)
    code, word, tf, df, votes = counted(points, offsets, marks)
    n, prior = len(texts), marks.sum(0)
    keep = np.flatnonzero((df >= least_documents(n)) & (df <= 0.25 * n) & telling(tf, df, votes, prior + 0.5))
    if not len(keep) or not any(labels):
        return unfit(subjects)
    terms = Terms(code[keep], [spelled(int(code[i]), word[i]) for i in keep], tf[keep], df[keep], votes[keep], n, prior)
    sentence, term, row = pairs(points, offsets, Lookup(terms.code))
    block = Block(sentence, term, row, marks)
    return trained(lambda f, size, *state: summed(f(block, *state), size), terms, subjects, leaves, passes, block)


def unfit(subjects: list[str]) -> Model:
    return Model(subjects, [], np.zeros((0, 1)), np.full(1, len(subjects)))


def sample(documents: DataFrame, labels: DataFrame, subjects: list[str], fit_docs: int, fit_chars: int) -> tuple[list[str], list[set[str]]]:
    """At most ``fit_docs`` documents of ``fit_chars`` characters in all, labelled ones first, each in hash order.

    For trials with ``fit``; no query fits on it (``corpus_model`` takes all documents).
    Only ids are sorted; the texts are read once, and those of the at most ``2 * fit_docs`` candidates are kept in a table.
    """
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("s"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    marked = {r["doc_id"]: set(r["s"]) for r in clean.where("doc_id is not null").orderBy(*order).limit(fit_docs).collect()}
    ids = [*marked]
    if len(ids) < fit_docs:
        ids += [r["doc_id"] for r in documents.select("doc_id").where("doc_id is not null").orderBy(*order).limit(fit_docs).collect()]
    ids = [*dict.fromkeys(ids)]
    if not ids:
        return [], []
    texts = materialise(documents.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", "text"))
    size = {r["doc_id"]: r["n"] for r in texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()}
    chosen, room = [], fit_chars
    for i in ids:
        if len(chosen) < fit_docs and size.get(i, room + 1) <= room:
            chosen.append(i)
            room -= size[i]
    both: dict[str, set[str]] = {}
    for r in sorted(texts.where(F.col("doc_id").isin(chosen)).collect(), key=lambda r: (r["doc_id"], r["text"])):
        both.setdefault(r["text"], set()).update(marked.get(r["doc_id"], ()))
    return [*both], [*both.values()]


def labelled(documents: DataFrame, labels: DataFrame, names: list[str]) -> tuple[DataFrame, int, dict[str, float]]:
    """(_i, _first, _s) of the documents whose text is labelled or another document's too: whether they stand for the text,
    and the labels of all that hold it; the number of texts; the labels of each class, a text's labels sharing its vote."""
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("s")).where(F.col("s").isin(names) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("s").alias("s"))
    keyed = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    texts = keyed.join(clean, "doc_id", "left").groupBy("h").agg(F.min("doc_id").alias("top"), F.count(F.lit(1)).alias("c"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    texts = materialise(texts)
    votes = {r["x"]: r["v"] for r in texts.select(F.explode("s").alias("x"), (1 / F.size("s")).alias("v")).groupBy("x").agg(F.sum("v").alias("v")).collect()}
    marked = keyed.join(texts.where("c > 1 or size(s) > 0"), "h").select(F.col("doc_id").alias("_i"), (F.col("doc_id") == F.col("top")).alias("_first"), F.col("s").alias("_s")).distinct()
    return materialise(marked), texts.count(), votes


def corpus_model(documents: DataFrame, labels: DataFrame, names: list[str], other: str = "general", leaves: int = 60, passes: int = 2) -> tuple[DataFrame, Model]:
    """The sentences' terms of all documents (doc_id, first and the columns of ``packed``), and the model fitted on all."""
    spark = documents.sparkSession
    subjects = [s for s in names if s != other]
    classes = [*subjects, other]
    k = len(classes)
    marks, n, given = labelled(documents, labels, names)
    prior = np.array([given.get(c, 0.0) for c in classes])
    picked = documents.select("doc_id", "text")
    met = picked.join(F.broadcast(marks) if marks.count() <= MOST_REPEATED else marks, F.col("doc_id") == F.col("_i"), "left").select("doc_id", F.coalesce("_first", F.lit(True)).alias("first"), F.coalesce("_s", F.array().cast("array<string>")).alias("s"), "text")
    votes = [f"v{c}" for c in range(k)]

    def marks_of(column: pa.Array) -> np.ndarray:
        index = {s: i for i, s in enumerate(classes)}
        out = np.zeros((len(column), k))
        for i in np.flatnonzero(np.asarray(pa.compute.list_value_length(column))).tolist():
            own = column[i].as_py()
            for s in own:
                out[i, index[s]] = 1 / len(own)
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []

        def merged() -> tuple:
            code, word, numbers = (np.concatenate([x[i] for x in kept]) for i in range(3))
            order = np.argsort(code)
            first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
            return code[order][first], word[order][first], np.add.reduceat(numbers[order], first, axis=0)

        def rows(x: tuple) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(x[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][a : a + 50_000]), pa.array(x[1][a : a + 50_000], pa.string()), *[pa.array(v) for v in x[2][a : a + 50_000].T]], ["code", "word", "tf", "df", *votes])

        for batch in batches:
            for part in parts(batch.filter(batch.column(1))):
                code, word, tf, df, own = counted(*decode(part.column(3)), marks_of(part.column(2)))
                if len(code):
                    kept.append((code, np.array(word, object), np.column_stack((tf, df, own)).astype(np.float32)))
                if sum(len(x[0]) for x in kept) > 400_000:
                    kept = [merged()]
                    if len(kept[0][0]) > 300_000:
                        yield from rows(kept.pop())
        if kept:
            yield from rows(merged())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.get()
        for batch in batches:
            for part in parts(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *packed(*pairs(*decode(part.column(3)), lookup), part.num_rows)], ["doc_id", "first", *PACKED])

    if not sum(given.values()):
        codes, terms = np.zeros(0, np.int64), None
    else:
        each = met.mapInArrow(count, "code long, word string, tf float, df float, " + ", ".join(f"{v} float" for v in votes))
        sums = each.groupBy("code", "word").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ("tf", "df", *votes)]).where((F.col("df") >= least_documents(n)) & (F.col("df") <= 0.25 * n))
        share = [F.col(v) / float(q) + float(0.3 / (prior + 0.5).mean()) for v, q in zip(votes, prior + 0.5)]
        tied = (F.greatest(*share[:-1], F.lit(0.0)) >= 0.25 * reduce(Column.__add__, share)) & (reduce(Column.__add__, map(F.col, votes)) >= 1)
        rows = sums.where((F.col("tf") >= 1.05 * F.col("df")) | tied).toArrow().sort_by("code")
        codes = rows["code"].to_numpy()
        terms = Terms(codes, [spelled(c, w) for c, w in zip(codes.tolist(), rows["word"].to_pylist())], rows["tf"].to_numpy(), rows["df"].to_numpy(), np.stack([rows[v].to_numpy() for v in votes], axis=1), n, prior)
        del rows
    shared = Shared(spark, codes, Lookup)
    kind = documents.select("doc_id").dtypes[0][1]
    coded = materialise(met.mapInArrow(encode, f"doc_id {kind}, first boolean, " + ", ".join(f"{c} {t}" for c, t in PACKED.items())))
    if not len(codes):
        return coded, unfit(subjects)

    def total(counts: Callable[..., Counts], size: int, *state: object) -> np.ndarray:
        sent = spark.sparkContext.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size, np.float32)
            for batch in batches:
                batch = batch.filter(batch.column(0))
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    for i, v in counts(Block(*sentences_of(part, 1), marks=np.zeros((part.num_rows, 0))), *sent.value):
                        np.add.at(sums, i, v)
            at = np.flatnonzero(sums)
            yield from in_pieces(at, sums[at])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot, sums = np.full(-(-size // PIECE), -1), np.zeros((0, PIECE))
            for batch in batches:
                own = batch.column(0).to_numpy()
                new = np.unique(own[slot[own] < 0])
                slot[new] = len(sums) + np.arange(len(new))
                sums = np.concatenate((sums, np.zeros((len(new), PIECE)))) if len(new) else sums
                i, v = cells(batch)
                np.add.at(sums.reshape(-1), slot[i // PIECE] * PIECE + i % PIECE, v.astype(float))
            for own in np.array_split(np.flatnonzero(slot >= 0), max(1, len(sums) * PIECE >> 20)):
                k, i = np.nonzero(sums[slot[own]])
                yield from in_pieces(own[k] * PIECE + i, sums[slot[own[k]], i].astype(np.float32))

        kind = "piece int, i binary, v binary"
        got = coded.select("first", *PACKED).mapInArrow(run, kind).repartition(spark.sparkContext.defaultParallelism, "piece").mapInArrow(merge, kind).toArrow()
        sent.destroy()
        out = np.zeros(size)
        for batch in got.to_batches():
            i, v = cells(batch)
            out[i] = v
        return out

    return coded, trained(total, terms, subjects, leaves, passes)


#: Columns of texts as pairs, in bytes: sentences, terms in each (int32), and the terms' low 16 bits and the bits above.
PACKED = {"n": "int", "sizes": "binary", "low": "binary", "high": "binary"}


def rows_of_bytes(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary array whose rows hold the values from one edge to the next."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def bytes_of_rows(column: pa.Array, kind: type) -> np.ndarray:
    """The values of all rows of a binary array end to end."""
    if not len(column):
        return np.zeros(0, kind)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    marks = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data.slice(int(marks[0]), int(marks[-1] - marks[0])).to_pybytes(), kind) if data is not None else np.zeros(0, kind)


def packed(sentence: np.ndarray, term: np.ndarray, row: np.ndarray, rows: int) -> list[pa.Array]:
    """The columns of ``PACKED``; ``sentences_of`` is the inverse."""
    total = np.bincount(row, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(total)))
    sizes = np.bincount(sentence, minlength=len(row)).astype(np.int32)
    edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))[begin]
    return [pa.array(total.astype(np.int32)), rows_of_bytes(sizes, begin), rows_of_bytes((term & 0xFFFF).astype(np.uint16), edges), rows_of_bytes((term >> 16).astype(np.uint16), edges)]


def sentences_of(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, term, text of each sentence) of rows whose columns from ``at`` are those of ``PACKED``."""
    total = np.asarray(part.column(at)).astype(np.int64)
    sizes, low, high = (bytes_of_rows(part.column(at + i), kind) for i, kind in ((1, np.int32), (2, np.uint16), (3, np.uint16)))
    return np.repeat(np.arange(len(sizes)), sizes), low.astype(np.int64) | high.astype(np.int64) << 16, np.repeat(np.arange(len(total)), total)


#: Cells of a vector that are sent in one row.
PIECE = 512


def in_pieces(at: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (piece, i, v) of a vector that is ``values`` (float32) at the cells ``at``, in order, and 0 elsewhere."""
    begin = np.flatnonzero(np.concatenate(([True], np.diff(at // PIECE) != 0))) if len(at) else np.zeros(0, np.int64)
    for a in range(0, len(begin), 1000):
        edges = np.append(begin, len(at))[a : a + 1001]
        own = slice(edges[0], edges[-1])
        yield pa.RecordBatch.from_arrays([pa.array((at[edges[:-1]] // PIECE).astype(np.int32)), rows_of_bytes((at[own] % PIECE).astype(np.uint16), edges - edges[0]), rows_of_bytes(values[own], edges - edges[0])], ["piece", "i", "v"])


def cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(cell, value) of the rows of ``in_pieces``."""
    i, v = bytes_of_rows(batch.column(1), np.uint16), bytes_of_rows(batch.column(2), np.float32)
    sizes = np.asarray(pa.compute.binary_length(batch.column(1))) // 2
    return np.repeat(np.asarray(batch.column(0)).astype(np.int64) * PIECE, sizes) + i, v


def assign(coded: DataFrame, model: Model, share: float = 0.15, other: str = "general") -> DataFrame:
    """(doc_id, subject, n_sentences, n_total): one row per document and subject; no shuffle."""
    shared = Shared(coded.sparkSession, model, lambda x: x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = shared.get()
        number = np.full(int(ready.numbers.max()) + 1 if len(ready.numbers) else 1, -1)
        number[ready.numbers] = np.arange(len(ready.numbers))
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sentence, term, row = sentences_of(part, 1)
                term = np.where(term < len(number), number[np.minimum(term, len(number) - 1)], -1)
                found, total = ready.mixed(sentence[term >= 0], term[term >= 0], row, part.num_rows), np.bincount(row, minlength=part.num_rows)
                enough = (found >= share * total[:, None] - 1e-9) & (found > 0)
                r, s = np.nonzero(enough)
                plain = np.flatnonzero(~enough.any(1))
                names = [ready.subjects[i] for i in s.tolist()] + [other] * len(plain)
                count = np.concatenate((found[r, s], (total - found.sum(1))[plain])).astype(np.int64)
                where = np.concatenate((r, plain))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), pa.array(names, pa.string()), pa.array(count), pa.array(total[where].astype(np.int64))], ["doc_id", "subject", "n_sentences", "n_total"])

    return coded.select("doc_id", *PACKED).mapInArrow(run, f"doc_id {coded.dtypes[0][1]}, subject string, n_sentences long, n_total long")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = 0.15) -> DataFrame:
    names = sorted(r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    return assign(*corpus_model(documents, labels, names), share=share)
