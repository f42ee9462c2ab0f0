"""Dialogue (D1-D10, D12): quotations with their surroundings, speaker and tag beside them, speaker profiles, functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import lexicons as L
from inkmill.functions.frames import computed
from inkmill.functions.text import strip, total
from inkmill.operators.noise import with_clean

TAGS = sorted(L.SPEECH_TAGS, key=lambda t: (-len(t), t))
EDGE = rf"，。！？…—{L.WS}"
LEAD = "^(?:在|向|对|朝|冲|随着|只听|听到|忽听|便听|却见|只见)"
ADVERB_TAIL = "^(.{2,}?)(?:" + "|".join(sorted(L.ADVERBS, key=len, reverse=True)) + ")$"
PARTICLE_TAIL = "^(.{3,}?)(?:的|地|着)$"
VERB_TAIL = "^(.{2,}?)(?:" + "|".join(sorted(L.VERB_TAILS, key=len, reverse=True)) + ")$"
REACH, NEAR = 12, 7


def accepted(name: Column) -> Column:
    return F.length(name).between(2, 4) & ~name.isin(L.NO_NAMES) & ~name.rlike(f"[{L.NAME_STOPS}]")


def repeated(c: Column, step, times: int) -> Column:
    """``step`` applied so many times; a fold, so the expression does not grow with the rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), c, lambda x, _: step(x))


def bare_name(c: Column) -> Column:
    """A candidate without adverbs and particles at its end; each round takes a character at least, and a dozen is the most there are."""
    return repeated(c, lambda x: F.when(F.length(x) < 4, x).when(x.rlike(PARTICLE_TAIL), F.regexp_replace(x, PARTICLE_TAIL, "$1")).otherwise(F.regexp_replace(x, ADVERB_TAIL, "$1")), REACH)


def normal_name(c: Column) -> Column:
    c = F.regexp_replace(c, "^[“”\"'「」『』…—，。！？!:：；;，、 ]+|[“”\"'「」『』…—，。！？!:：；;，、 ]+$", "")
    return repeated(c, lambda x: F.when(F.length(x) > 2, F.regexp_replace(x, VERB_TAIL, "$1")).otherwise(x), 4)  # a name has four characters at most


def plausible(name: Column) -> Column:
    return (name != "") & ~name.isin(["她", "他", "它", "她俩", "他俩", *L.NO_NAMES]) & ~((F.length(name) == 2) & name.rlike("^[她他它]")) & ~name.rlike("[的了吗呢吧啊呀哦嘛]") & name.rlike(r"^[\x{4e00}-\x{9fa5}A-Za-z·]{2,6}$")


def quotes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per quotation: key, q_no, pos (0-based), content, block, name and tag.

    ``block`` is the thousand of characters the quotation begins in, standing in for a chapter.  Name and tag are read
    from the text beside the quotation, null where a word merely looks like a tag.
    """
    clean = with_clean(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    wide = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    both = computed(clean, [key], o=F.split("clean", L.QUOTE, -1), m=F.regexp_extract_all("clean", F.lit(L.QUOTE), F.lit(0)))
    both = computed(both, [key, "m"], z=F.arrays_zip("o", "m"), ol=wide(F.col("o")), ml=wide(F.col("m")))
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.coalesce(x["o"], F.lit("")), F.coalesce(x["m"], F.lit("")))), "")

    def row(q: Column, i: Column) -> Column:
        first = F.greatest(i - NEAR, F.lit(0))
        before = F.concat(join(F.slice("z", first + 1, i - first)), F.element_at("z", i + 1)["o"])
        after = join(F.slice("z", i + 2, F.lit(NEAR + 1)))
        return F.struct(
            (i + 1).alias("q_no"), (total(F.slice("ol", F.lit(1), i + 1)) + total(F.slice("ml", F.lit(1), i))).alias("pos"),
            strip(F.substring(q, F.lit(2), F.length(q) - 2)).alias("content"), strip(F.right(before, F.lit(REACH))).alias("left"), strip(F.left(after, F.lit(REACH))).alias("right"),
        )

    rows = both.select(key, F.explode(F.transform("m", row)).alias("r")).select(key, "r.*").where(F.col("content") != "")
    base = [key, "q_no", "pos", "content"]
    tag = lambda w: F.when(~w.rlike("|".join(L.NO_TAGS)), F.try_element_at(F.filter(F.array(*map(F.lit, TAGS)), lambda t: F.contains(w, t)), F.lit(1)))
    rows = computed(rows, [*base, "left", "right"], a_tag=tag(F.col("left")), b_tag=tag(F.col("right")))
    raw = lambda w, t: strip(F.regexp_replace(F.regexp_replace(strip(F.call_function("substring_index", F.col(w), F.col(t), F.lit(1))), f"^[{EDGE}]+|[{EDGE}]+$", ""), LEAD, ""))
    rows = computed(rows, [*base, "a_tag", "b_tag"], a_raw=raw("left", "a_tag"), b_raw=raw("right", "b_tag"))
    rows = computed(rows, [*base, "a_tag", "b_tag", "a_raw", "b_raw"], a_short=bare_name(F.col("a_raw")), b_short=bare_name(F.col("b_raw")))
    pick = lambda s: F.when(accepted(F.col(f"{s}_raw")), F.col(f"{s}_raw")).when(accepted(F.col(f"{s}_short")), F.col(f"{s}_short"))
    rows = computed(rows, [*base, "a_tag", "b_tag"], a_name=pick("a"), b_name=pick("b"))
    name = F.coalesce("a_name", "b_name")
    tag = F.when(F.col("a_name").isNotNull(), F.col("a_tag")).when(F.col("b_name").isNotNull(), F.col("b_tag")).otherwise(F.coalesce("a_tag", "b_tag"))
    return rows.select(*base, F.floor(F.col("pos") / 1000).alias("block"), name.alias("name"), tag.alias("tag"))


def function_of(content: Column) -> Column:
    out = F.when(content.rlike(L.FUNCTIONS[0][1]), L.FUNCTIONS[0][0])
    for label, words in L.FUNCTIONS[1:]:
        out = out.when(content.rlike(words), label)
    return out.otherwise("信息交换")


def dialogue_functions(df: DataFrame, key: str, text: str) -> DataFrame:
    """Quotations per text and function."""
    return quotes(df, key, text).groupBy(key, function_of(F.col("content")).alias("function")).agg(F.count(F.lit(1)).alias("n"))


def tag_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    return quotes(df, key, text).where("tag is not null").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def speakers(df: DataFrame, key: str, text: str) -> DataFrame:
    """One profile per text and speaker: lines, blocks, mean length of lines cut at 50, favourite tag, tone, confidence."""
    q = computed(quotes(df, key, text).where("name is not null"), [key, "q_no", "content", "block", "name", "tag"], speaker=normal_name(F.col("name"))).where(plausible(F.col("speaker")))
    c = F.col("content")
    # one shuffle by speaker serves the profile and the favourite tag
    q = q.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "speaker", "tag"))).withColumn("first", F.min("q_no").over(Window.partitionBy(key, "speaker", "tag")))
    prof = q.groupBy(key, "speaker").agg(
        F.max_by("tag", F.struct("n", -F.col("first"))).alias("fav_tag"),
        F.count(F.lit(1)).alias("lines"), F.countDistinct("block").alias("blocks"), F.sum(F.length(F.substring(c, 1, 50))).alias("chars"),
        F.count_if(c.rlike("[？?]$")).alias("asks"), F.count_if(c.rlike("[！!]$")).alias("exclaims"), F.countDistinct("name").alias("spellings"),
    )
    n = F.col("lines")
    tone = F.when(F.col("asks") * 10 > n * 3, "asking").when(F.col("exclaims") * 5 > n, "commanding").otherwise("stating")
    return prof.select(key, "speaker", "lines", "blocks", (F.col("chars").cast("double") / n).alias("avg_line"), "fav_tag", "spellings", tone.alias("tone"), F.when((n >= 3) & (F.col("blocks") >= 2), "high").otherwise("low").alias("confidence"))
