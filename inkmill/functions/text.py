"""Column expressions over text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



#: The characters of the class WS, one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column, extra: str = "") -> Column:
    """Without Unicode white space (and ``extra`` characters) at both ends; looks at the ends only, unlike a regex."""
    return F.btrim(c, F.lit(BLANKS + extra))


def grams(c: Column, n: int) -> Column:
    """All character n-grams in order; cut from an array, as cutting from a string walks it from its start each time."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    whole = F.aggregate(F.array(chars), F.array().cast("array<string>"), lambda _, a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(a, i, F.lit(n)), "")))
    return F.when(F.length(c) >= n, whole).otherwise(F.array().cast("array<string>"))


def count(c: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def count_chars(c: Column, characters: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, characters, ""))).cast("long")


def count_word(c: Column, word: str) -> Column:
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("long")


def count_words(c: Column, words: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for w in words:
        total = total + count_word(c, w)
    return total


def pieces(c: Column, pattern: str) -> Column:
    """Stripped non-empty parts between matches of ``pattern``."""
    return F.filter(F.transform(F.split(c, pattern, -1), lambda x: strip(x)), lambda x: x != "")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found
