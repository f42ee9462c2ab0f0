"""Numbers in reports (G1-G6): measured values by name, placeholders, labels, and claims that contradict what was measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.text import strip
from inkmill.operators.noise import lines
from inkmill.operators.ratios import measures


def metric_values(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mid, token, unit, value): the registered measures of every text, in long form; those a text lacks have no row."""
    read = measures(df, [key], text).select("*", (F.col("quoted") * 100.0).alias("quoted_pct"))
    rows = F.array(*[F.struct(F.lit(m).alias("mid"), F.lit(t).alias("token"), F.lit(u).alias("unit"), F.col(c).cast("double").alias("value")) for m, t, u, c in L.METRICS])
    return read.select(key, F.explode(F.filter(rows, lambda x: x["value"].isNotNull())).alias("x")).select(key, "x.*")


def shown(value: Column, digits: int = 2) -> Column:
    """A number as text, rounded, without zeros that say nothing; whole numbers keep theirs."""
    text = F.format_number(F.round(value, digits), digits)
    return F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), r"\.?0+$" if digits else r"^$", "")


def filled(templates: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """(key, text, unresolved): ``{{token}}`` and ``{{metric:MID|token}}`` replaced by the values (key, mid, token, value) of the key.

    Unknown placeholders stay and are listed, sorted and once each.
    """
    per = values.select(key, "mid", "token", shown(F.col("value")).alias("v")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "v"))).alias("by_token"), F.map_from_entries(F.collect_list(F.struct("mid", "v"))).alias("by_mid"))
    both = templates.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).join(per, key, "left")
    marks = F.array_distinct(F.regexp_extract_all("t", F.lit(L.PLACEHOLDER), F.lit(0)))

    def value(m: Column) -> Column:
        mid = F.regexp_extract(m, L.PLACEHOLDER, 1)
        return F.when(mid != "", F.try_element_at("by_mid", mid)).otherwise(F.try_element_at("by_token", F.regexp_extract(m, L.PLACEHOLDER, 2)))

    known = F.transform(marks, lambda m: F.struct(m.alias("m"), value(m).alias("v")))
    out = both.select(key, "t", known.alias("k"))
    text_ = F.aggregate("k", F.col("t"), lambda s, x: F.when(x["v"].isNotNull(), F.replace(s, x["m"], x["v"])).otherwise(s))
    return out.select(key, text_.alias("text"), F.array_join(F.sort_array(F.transform(F.filter("k", lambda x: x["v"].isNull()), lambda x: x["m"])), ",").alias("unresolved"))


def answer_health(df: DataFrame, key: str, text: str, least: int = 1000, least_body: int = 5) -> DataFrame:
    """(key, missing_parts, missing_sections, short_sections, prose_chars, healthy): the four parts and eleven numbered sections of a written report.

    Headings must stand as lines of their own; the last section ends at the second part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    heading = r"(?m)^###\s+1\.(\d+)\b[^\n]*\n"
    parts = [F.when(~t.rlike(rf"(?m)^##\s*[^\n]*{p}[^\n]*$"), F.lit(p)) for p in L.REPORT_PARTS]
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(heading), F.lit(1)), lambda x: x.cast("int")))
    parted = F.split(t, heading, -1)
    bodies = F.transform(F.slice(parted, F.lit(2), F.size(parted)), lambda b: F.length(strip(F.call_function("substring_index", b, F.lit("## 第二部分"), F.lit(1)))))
    out = df.select(
        key, F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ",").alias("missing_parts"), F.size(F.array_except(F.sequence(F.lit(1), F.lit(11)), numbers)).alias("missing_sections"),
        F.size(F.filter(bodies, lambda n: n < least_body)).alias("short_sections"), F.length(strip(t)).alias("prose_chars"),
    )
    return out.select("*", ((F.col("missing_parts") == "") & (F.col("missing_sections") == 0) & (F.col("short_sections") == 0) & (F.col("prose_chars") >= least)).alias("healthy"))


def metric_token(label: Column) -> Column:
    """The registered name a label means: the name itself, with or without ``_pct``, else the first alias it holds; null for none."""
    c = F.lower(strip(label))
    names = [t for t, _ in L.METRIC_ALIASES]
    out = F.lit(None).cast("string")
    for token, aliases in reversed(L.METRIC_ALIASES):
        out = F.when(c.rlike("|".join(aliases)), token).otherwise(out)
    bare = F.regexp_replace(c, "_pct$", "")
    return F.when(c == "", F.lit(None).cast("string")).when(c.isin(names), c).when(bare.isin(names), bare).otherwise(out)


def metric_tokens(items: DataFrame) -> DataFrame:
    """(item_id, metric, token) of every citation, each delivery once."""
    once = items.groupBy("item_id").agg(F.max_by("metric", "ingested_at").alias("metric"))
    return once.select("item_id", "metric", metric_token(F.col("metric")).alias("token"))


def audit(df: DataFrame, key: str, text: str, values: DataFrame) -> DataFrame:
    """(key, token, written, measured, severity): numbers written beside a measure's name that lie outside its tolerance.

    Lines are met with the rules as one array, so nothing is multiplied by a join; lines of quoted evidence are left out,
    placeholders in others are.  A tolerance is a share of the measured value (0.02 at least) or a difference.
    """
    line = F.explode(lines(F.coalesce(F.col(text), F.lit("")))).alias("l")
    said = df.select(key, line).where(~F.col("l").rlike(r"^\s*(?:[-*]\s*)?\[[a-zA-Z0-9_-]+\]")).select(key, F.regexp_replace("l", L.PLACEHOLDER, "").alias("l"))
    found = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(kind).alias("kind"), F.lit(tol).alias("tol"), F.regexp_extract_all("l", F.lit(p), F.lit(1)).alias("w")) for t, p, kind, tol in L.AUDIT_RULES])
    claims = said.select(key, F.explode(F.filter(found, lambda x: F.size(x["w"]) > 0)).alias("x")).select(key, "x.token", "x.kind", "x.tol", F.explode("x.w").alias("written"))
    met = claims.join(values.select(key, "token", F.col("value").alias("measured")), [key, "token"])
    number = F.replace("written", F.lit(","), F.lit("")).cast("double")
    limit = F.when(F.col("kind") == "rel", F.greatest(F.abs("measured") * F.col("tol"), F.lit(0.02))).otherwise(F.col("tol"))
    return met.where(F.abs(number - F.col("measured")) > limit).select(key, "token", "written", "measured", F.when(F.col("token").isin(L.CORE_METRICS), "error").otherwise("warning").alias("severity"))

