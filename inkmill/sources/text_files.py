"""Text files of unknown encoding (S1-S2, S4): one row per file with its text, the encoding found, or the reason for none."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions.frames import ship
from inkmill.functions.text import strip
from inkmill.operators.noise import with_clean

#: Byte order marks, longest first, and the encodings tried without one, in this order.
MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
TRIED = ["utf-8", "gb18030", "gbk", "big5"]


CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f]")


def sane(text: str, encoding: str) -> bool:
    """No replacement characters, no NUL but from wide encodings, few control characters."""
    controls = len(CONTROL.findall(text))
    return "�" not in text and ("\0" not in text or encoding in ("utf-16", "utf-32")) and controls <= max(2, len(text) // 1000)


def decoded(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding); both None for null, or where no encoding fits."""
    if data is None:
        return None, None
    marked = [name for mark, name in MARKS if data.startswith(mark)][:1]
    for encoding in marked or TRIED:
        try:
            text = data.decode(encoding)
        except UnicodeDecodeError:
            continue
        if sane(text, encoding):
            return text, encoding
    return None, None


def decode_column(df: DataFrame, keep: list[str], content: str) -> DataFrame:
    picked = df.select(*keep, F.col(content).alias("_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = zip(*map(decoded, batch.columns[-1].to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(names, pa.string())], [*keep, "text", "encoding"])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in picked.dtypes[:-1]) + ", text string, encoding string")


def read_text_files(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(path, text, encoding, problem): problem is null, ``undecodable`` or ``too_short`` (under ``least`` characters without noise lines)."""
    ship(spark)
    out = with_clean(decode_column(spark.read.format("binaryFile").load(path), ["path"], "content"), "text")
    return out.select("path", "text", "encoding", F.when(F.col("text").isNull(), "undecodable").when(F.length(strip(F.col("clean"))) < least, "too_short").alias("problem"))
