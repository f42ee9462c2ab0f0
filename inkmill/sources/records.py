"""Records as JSON and as tables (S3-S6, S9): JSON files, machine blocks of written answers, texts in memory, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from inkmill.functions.text import strip

BLOCK = r"(?s)```json\s*(\{.*?\})\s*```"
NAKED = r"(?s)(\{.*\"technique_cards\".*\})\s*$"


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row per JSON file or list element, by an explicit schema; broken files give nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def in_memory(spark: SparkSession, texts: list[tuple[str, str]], least: int = 50) -> DataFrame:
    """(title, text) rows; an error where a text without its outer space is shorter than ``least`` characters."""
    df = spark.createDataFrame(texts, "title string, text string")
    return df.select("title", long_enough(F.col("text"), least).alias("text"))


def long_enough(text: Column, least: int = 50) -> Column:
    """The text, or an error when it is read and has fewer than ``least`` characters without its outer space."""
    return F.when(F.length(strip(F.coalesce(text, F.lit("")))) >= least, text).otherwise(F.raise_error(F.lit(f"fewer than {least} characters")))


def parsed_answers(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, prose, record): the last fenced JSON block of an answer, else a bare object with cards at its end, and the text without it.

    ``record`` is null where there is none or it is no valid object; the prose is then the whole text.  Null texts stay null.
    """
    t = F.col(text)
    fenced = F.try_element_at(F.regexp_extract_all(t, F.lit(BLOCK), F.lit(1)), F.lit(-1))
    naked = F.when(t.rlike(NAKED), F.regexp_extract(t, NAKED, 1))
    base = df.select(*keep, t.alias("t"), F.coalesce(fenced, naked).alias("j"), fenced.isNotNull().alias("fenced"))
    valid = F.try_parse_json("j").isNotNull()
    around = F.regexp_replace(F.col("t"), F.concat(F.lit(r"```json\s*\Q"), F.col("j"), F.lit(r"\E\s*```")), F.lit(""))
    before = F.left(F.col("t"), F.locate("\x00", F.concat(F.regexp_replace("t", NAKED, "\x00"), F.lit("\x00"))) - 1)
    return base.select(*keep, strip(F.when(~F.coalesce(valid, F.lit(False)), F.col("t")).when(F.col("fenced"), around).otherwise(before)).alias("prose"), F.when(valid, F.col("j")).alias("record"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, table): the rows of each group as one Markdown table in the given order; bars in cells are escaped, nulls are empty.

    For report tables of bounded size: a group's rows come together in one row.
    """
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n" + "|" + " --- |" * len(columns) + "\n"
    rows = df.select(*(by or []), F.struct(*order, line.alias("_line")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_line"]), "\n")
    return rows.groupBy(*(by or [])).agg(F.concat(F.lit(head), body).alias("table"))
