"""Core operators on small inputs: against brute force, fixed vectors and edge cases."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkmill.functions.frames import latest, latest_texts, shared_dir
from inkmill.functions.probes import find_quotes
from inkmill.functions.text import grams, strip
from inkmill.operators import compare, dialogue, evidence, fidelity, identity, noise, packed, ratios, report, structure, style, tokenizer, voices
from inkmill.sources import records, text_files
from inkmill.streaming import style_stream

DOCS = "doc_id long, text string, doc_id2 string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "第1章 山门\n　　她的手指宛如冰锥。他转身离开。\r\n\r\n求月票：谢谢\n====\n“走吧。”林砚说道。“别回头！”\n", "x"),
        (2, None, None), (3, "", "y"), (4, "  \n ", "z"), (5, "他说：“好吗？”苏疏笑道，“好。”" * 60, "z"), (6, "\x00a\n作者有话说 明天见\n看 https://a.b/c\n正文", "q"), (7, "很长" * 20000, "q"),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_strip_matches_python(spark):
    texts = ["　 a b\x85", " x ", "", "\x1c\x1d", "无"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_noise(docs):
    rows = {r.doc_id: r for r in noise.noise_stats(docs, "doc_id", "text").collect()}
    assert (rows[1].platform_notes, rows[1].structural_dividers, rows[1].removed_lines) == (1, 1, 2)
    assert (rows[6].corrupted_lines, rows[6].platform_notes, rows[6].watermarks) == (1, 1, 1)
    assert rows[2].raw_chars == rows[3].raw_chars == 0 and rows[4].removed_lines == 0
    assert all(r.raw_chars >= r.clean_chars + r.removed_chars for r in rows.values())


def test_style_core_against_python(docs):
    rows = {r.doc_id: r for r in style.style_core(docs, ["doc_id"], "text").collect()}
    text = "他说：“好吗？”苏疏笑道，“好。”" * 60
    sents = [s.strip() for s in re.split("[。！？\n]", text) if s.strip()]
    assert (rows[5].n_sentences, rows[5].sentence_chars, rows[5].n_comma) == (len(sents), sum(map(len, sents)), text.count("，"))
    assert rows[2].n_sentences == 0 and rows[2].avg_sentence == 0.0 and rows[7].total_chars == 40000


@pytest.mark.parametrize("sentence,expected", [
    ("她的手指宛如冰锥", True), ("他像一道闪电冲了出去", True), ("剑光如一柄长刀劈下", True), ("这件事不像他做的", False), ("如果明天下雨就不去", False), ("他始终如一", False), ("墙上挂着一张画像", False), ("例如这样的事情", False),
])
def test_simile(spark, sentence, expected):
    assert spark.range(1).select(style.is_simile(F.lit(sentence)).alias("x")).first().x is expected


def test_medians_and_tokens(docs):
    stats = {r.doc_id: r for r in style.sentence_stats(docs, ["doc_id"], "text").collect()}
    assert stats[2].median_length is None and stats[5].min_length >= 1
    vocab = {r.doc_id: r for r in style.vocabulary_richness(docs, ["doc_id"], "text").collect()}
    assert vocab[7].total_words == 39999 and vocab[7].unique_words == 2 and 2 not in vocab


@pytest.mark.parametrize("values,expected", [([1, 2, 3, 4], "rising"), ([4, 3, 2, 1], "falling"), ([10, 10.2, 9.9, 10.1], "steady"), ([1, 9, 1, 9], "rising"), ([9, 1, 9, 1, 9], "steady"), ([5], "too_few"), ([], "too_few"), ([0, 0, 0], "steady")])
def test_trend(spark, values, expected):
    if values in ([1, 9, 1, 9], [9, 1, 9, 1, 9]):
        expected = "shifting"
    arr = F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")
    assert spark.range(1).select(compare.trend(arr).alias("t")).first().t == expected


def test_quotes_and_speakers(docs):
    rows = dialogue.quotes(docs, "doc_id", "text").where("doc_id = 1").orderBy("q_no").collect()
    assert [(r.content, r.name, r.tag) for r in rows][0] == ("走吧。", "林砚", "说道")
    people = dialogue.speakers(docs, "doc_id", "text").where("doc_id = 5").collect()
    assert people and all(p.lines > 0 for p in people)


def test_fold_is_lossless(docs):
    rows = structure.fold_chunks(docs, "doc_id", "text", 50).groupBy("doc_id").agg(F.sum("n_chars").alias("n")).collect()
    sizes = {r.doc_id: r.n for r in rows}
    assert sizes == {r.doc_id: len(r.text) for r in docs.collect() if r.text}


def test_interval_join(spark):
    points = spark.createDataFrame([("w", 5), ("w", 9000), ("w", 99), (None, 3)], "k string, p long")
    spans = spark.createDataFrame([("w", 0, 10, "a"), ("w", 10, 20000, "b"), ("w", 7, 7, "empty")], "k string, s long, e long, id string")
    rows = {(r.k, r.p): r.id for r in structure.interval_join(points, spans, "k", "p", "s", "e").collect()}
    assert rows == {("w", 5): "a", ("w", 9000): "b", ("w", 99): "b", (None, 3): None}


def test_grams_and_overlap(spark):
    got = spark.createDataFrame([("abcd",), ("ab",), (None,)], "t string").select(grams(F.col("t"), 3).alias("g")).collect()
    assert [r.g for r in got][:2] == [["abc", "bcd"], []]
    trials = spark.createDataFrame([(1, "x" * 10 + "y" * 50), (2, "nothing")], "id long, text string")
    refs = spark.createDataFrame([("y" * 60,)], "r string")
    rows = {r.id: r for r in compare.copy_risk(trials, "id", "text", refs, "r").collect()}
    assert rows[1].at_risk and not rows[2].at_risk


def test_ascii_names_are_whole_words(spark):
    works = spark.createDataFrame([("w", "Ash", "林砚"), ("v", "The C++ \\E Way", None)], "work_id string, author_name string, title string").select("work_id", "author_name", "title")
    chunks = spark.createDataFrame([("w", "c1", "Ashes washed Ash, and Ash_1; 林砚说", 1), ("w", "c2", "only Ashes", 1), ("v", "c1", "(The C++ \\E Way) Then", 1)], "work_id string, chunk_id string, chunk_text string, ingested_at long")
    assert sorted(map(tuple, evidence.leak_scan(works, chunks).collect())) == [("v", "c1", "author", 1), ("w", "c1", "author", 1), ("w", "c1", "title", 1)]
    texts = {(r.work_id, r.chunk_id): r.masked for r in evidence.masked(works, chunks).collect()}
    assert texts == {("w", "c1"): "Ashes washed 某作者, and Ash_1; 某书说", ("w", "c2"): "only Ashes", ("v", "c1"): "(某作者) Then"}


def test_masking_replaces_no_label_again(spark):
    works = spark.createDataFrame([("w", "作者", "某作者的书"), ("v", None, None), ("u", "林", "林")], "work_id string, author_name string, title string")
    chunks = spark.createDataFrame([("w", "c1", "某作者的书，作者\ue000", 1), ("v", "c1", "作者", 1), ("u", "c1", None, 1), ("w", "c2", None, 1)], "work_id string, chunk_id string, chunk_text string, ingested_at long")
    texts = {(r.work_id, r.chunk_id): r.masked for r in evidence.masked(works, chunks).collect()}
    assert texts == {("w", "c1"): "某书，某作者\ue000", ("v", "c1"): "作者", ("u", "c1"): None, ("w", "c2"): None}


def test_copy_risk_moves_no_grams(spark):
    trials = spark.createDataFrame([(1, "abcdefgh" * 30)], "id long, t string")
    plan = compare.copy_risk(trials, "id", "t", trials.withColumnRenamed("t", "r"), "r")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [id" in x and "," in x.split("Aggregate [")[1].split("]")[0]]


def test_corpus_copy_risk_agrees_with_all_grams(spark):
    body = "山门夜雨连绵不绝，他提着灯走过长廊。The lamps went out one by one until nobody was awake"
    trials = spark.createDataFrame([(1, "前言" + body[10:70] + "后记"), (2, "nothing of it"), (3, None), (4, ""), (5, body[:39]), (6, body * 5), (7, "灯走过长" * 60)], "id long, text string")
    refs = spark.createDataFrame([(body,), (body,), (None,), ("",), ("灯走过长灯走",), ("短",)], "r string")
    mine, brute = (sorted(map(tuple, f(trials, "id", "text", refs, "r").collect())) for f in (compare.corpus_copy_risk, compare.copy_risk))
    assert mine == brute and [r[0] for r in mine if r[-1]] == [1, 6]
    assert not compare.corpus_copy_risk(trials, "id", "text", refs.limit(0), "r").where("at_risk").count() and not compare.corpus_copy_risk(trials.limit(0), "id", "text", refs, "r").count()


def test_copies_from_the_books_are_seen(spark, tmp_path):
    from inkmill.plans.queries import QUERIES

    stretch = "他提着灯走过长廊心里想着旧事一路上没有人说话只有雨声敲打屋檐像旧年的更鼓门外的人影渐渐散去"
    spark.createDataFrame([(1, "trial", "甲" + stretch), (2, "review", stretch)], "doc_id long, doc_kind string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("w", "c1", "前" + stretch)], "work_id string, chunk_id string, chunk_text string").write.parquet(str(tmp_path / "evidence_store.parquet"))
    assert [(r.doc_id, r.at_risk) for r in QUERIES["copy_risk_books"](spark, str(tmp_path)).collect()] == [(1, True)]


CHUNKS = "work_id string, chunk_id string, seq int, start_pos long, chunk_text string, era string, ingested_at long"
ITEMS = "item_id long, work_id string, chunk_id string, quote string, ingested_at long"


def test_verify(spark):
    chunks = spark.createDataFrame([("w", "c001", 1, 0, "他说——走吧走吧走吧", "e", 1), ("w", "c1002", 1002, 99, "灯火阑珊处那人回首", "e", 1), ("w", "c002", 2, 10, "灯火阑珊处那人回首", "e", 1), ("v", "c001", 1, 0, "没有这句话的", "e", 1), ("w", "c009", 9, 50, None, "e", 1)], CHUNKS)
    items = spark.createDataFrame([(1, "w", " C001", "走吧走吧走吧", 1), (2, "w", "c001", "灯火阑珊处那人", 1), (3, "w", "c001", "没有这句话的", 1), (4, "w", None, None, 1), (1, "w", " C001", "走吧走吧走吧", 2), (5, "w", "c001", "走吧", 1)], ITEMS)
    assert {r.item_id: (r.status, r.chunk_id) for r in evidence.verify(items, chunks).collect()} == {1: ("valid", "c001"), 2: ("fixed", "c002"), 3: ("downgraded", None), 4: ("downgraded", None), 5: ("downgraded", None)}
    assert evidence.verify(items, chunks.limit(0)).where("status <> 'downgraded'").count() == 0 and evidence.verify(items.limit(0), chunks).count() == 0


def test_quotes_are_found_as_by_search(spark):
    rng = random.Random(4)
    texts = [(f"t{i}", rng.choice("gh"), "".join(rng.choices("山门夜雨他走", k=rng.choice([0, 5, 30, 400])))) for i in range(40)]
    quotes = [(g, t[a : a + n]) for _, g, t in texts for a, n in [(rng.randrange(60), rng.choice([6, 7, 11, 12, 25, 60]))]] + [("g", "他" * 30)]
    quotes = [(g, q, k) for k, (g, q) in enumerate(quotes) if len(q) >= 6]
    df, qs = spark.createDataFrame([*texts, ("n", "g", None)], "id string, g string, t string"), spark.createDataFrame(quotes, "g string, q string, quote_key long")
    brute = {(i, k) for i, g, t in texts for h, q, k in quotes if g == h and q in t}
    for most in (10_000, 7):
        rows = [tuple(r) for r in find_quotes(df, ["id"], "g", "t", qs, most=most).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == brute


@pytest.mark.parametrize("field,values", [
    (None, []), ("", []), ("  ", []), ("甲；乙;；丙 ", ["甲", "乙", "丙"]), ('["甲", "乙；丙"]', ["甲", "乙；丙"]), ("1、甲2、乙，至多1.5处3、丙", ["甲", "乙，至多1.5处", "丙"]), ("（1）甲（旁白/对白）\n（2）乙", ["甲（旁白/对白）", "乙"]),
    ("甲\\;乙;丙", ["甲;乙", "丙"]), ('"甲, 乙","丙""丁""戊"', ["甲, 乙", '丙"丁"戊']), ("「禁「一；二」列|含」|乙", ["禁「一；二」列|含", "乙"]), ("- a\r\n- b", ["a", "b"]), ("①甲；②乙", ["甲", "乙"]), ("甲；甲", ["甲", "甲"]),
])
def test_packed_fields(field, values):
    assert packed.segment(field) == values


def test_packed_dictionary_protects_values():
    known = packed.automaton(["少用甲；无例外"])
    assert packed.segment("少用甲；无例外；乙") == ["少用甲", "无例外", "乙"]
    assert packed.segment("少用甲；无例外；乙", known) == ["少用甲；无例外", "乙"]


def test_known_values_cut_at_weak_separators():
    known = packed.automaton(["甲不写", "乙不写", "丙不写", "戊不写，尤其在章末"])
    for mark in (", ", "，", "、", "/"):
        text = mark.join(["甲不写", "乙不写", "丙不写"])
        assert packed.segment(text, known) == ["甲不写", "乙不写", "丙不写"] and packed.segment(text) == [text]
    assert packed.segment("甲不写，尤其在章末；乙不写", known) == ["甲不写，尤其在章末", "乙不写"]  # the words behind the comma are no value
    assert packed.segment("戊不写，尤其在章末，甲不写;丁", known) == ["戊不写，尤其在章末", "甲不写", "丁"]
    wide = "；".join(f"款{i}" for i in range(100))
    assert packed.segment(f"{wide}；甲", packed.automaton([wide])) == [wide, "甲"]
    assert len(packed.segment("“" * 20_000 + "1、" * 20_000)) >= 1  # time in proportion to the length


def test_values_come_from_the_dictionary(spark):
    values = [f"第{i}款不写，除非{i}" if i % 3 == 0 else f"第{i}款不写；番外同" if i % 3 == 1 else f"第{i}款不写" for i in range(12)]
    rows, truth = [], {}
    for i in range(60):
        mine = [values[(i + k * 5) % 12] for k in range(3)]
        rows.append((i, ", ".join(f'"{v}"' for v in mine) if i < 40 else ("，" if i % 2 else "；").join(mine)))
        truth[i] = mine
    df = spark.createDataFrame(rows, "contract_id long, enemy_clauses string")

    def recall(**how):
        got = {(r.contract_id, r.pos, r.value) for r in packed.unpack(df, "contract_id", "enemy_clauses", **how).collect()}
        want = {(i, k + 1, v) for i, mine in truth.items() if i >= 40 for k, v in enumerate(mine)}
        return len(got & want) / len(want)

    assert recall() >= 0.97 and recall(most_chars=20) >= 0.97  # the latter in several blocks
    assert recall(min_count=1000) < 0.5  # an empty dictionary


def test_unpack(spark):
    df = spark.createDataFrame([(1, "甲；乙", 5), (1, "甲；乙", 6), (2, None, 7), (3, "", 8)], "contract_id long, enemy_clauses string, pos long")
    rows = sorted(packed.unpack(df, "contract_id", "enemy_clauses", pos="clause_pos", value="clause_text").collect())
    assert [tuple(r) for r in rows] == [(1, 1, "甲"), (1, 2, "乙")]
    assert packed.unpack(df.limit(0), "contract_id", "enemy_clauses").count() == 0


def test_text_files(spark, tmp_path):
    body = "林砚转身离开，山门夜雨。" * 8
    for name, data in {"a": body.encode(), "b": body.encode("gb18030"), "c": body.encode("utf-16"), "d": b"\x81", "e": b"short"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path[-1]: r for r in text_files.read_text_files(spark, str(tmp_path)).collect()}
    assert rows["a"].text == rows["b"].text == rows["c"].text == body and rows["b"].encoding == "gb18030"
    assert (rows["d"].problem, rows["e"].problem) == ("undecodable", "too_short")


def test_dictionary_tokens(spark):
    words = spark.createDataFrame([("中国", 50, "ns"), ("中国人", 20, "n"), ("人民", 60, "n"), ("国", 5, "n")], "word string, freq int, tag string")
    df = spark.createDataFrame([(1, "中国人民!人"), (2, None), (3, "")], "id long, text string")
    assert [(r.start_pos, r.word) for r in sorted(tokenizer.dictionary_tokens(df, "id", "text", words).collect())] == [(1, "中国"), (3, "人民"), (6, "人")]
    assert [(r.start_pos, r.word) for r in sorted(tokenizer.dictionary_tokens(df, "id", "text", words, full=True).collect())] == [(1, "中国"), (1, "中国人"), (2, "国"), (3, "人民"), (6, "人")]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("w", "他走了。她来了！"), ("w", "好。"), ("v", None)], "work string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = style_stream.running_style(stream, "work", "text").writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        q.processAllAvailable()
        rows = {r.work: r for r in spark.table("running").collect()}
    finally:
        q.stop()
    assert rows["w"].n_sentences == 3 and rows["v"].n_sentences == 0


def test_json_lists_keep_order():
    values = [f"条款{i}；续" for i in range(50)]
    assert packed.segment(json.dumps(values)) == values


def test_latest_texts_agrees_with_latest(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 4), rng.choice([1, 2, 3, None]), rng.choice(["x", "y", None])) for _ in range(60)]
    df = spark.createDataFrame(rows, "k string, n int, at int, t string")
    both = [sorted(map(str, f(df, ["k", "n"], "at", ["t"]).collect())) for f in (latest, latest_texts)]
    assert both[0] == both[1] and latest_texts(df.limit(0), ["k", "n"], "at", ["t"]).count() == 0
    once = df.dropDuplicates(["k", "n"])
    assert sorted(map(str, latest_texts(once, ["k", "n"], "at", ["t"]).collect())) == sorted(map(str, once.select("k", "n", "t").collect()))


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Fake:
        conf = spark.conf

        class sparkContext:
            master = "yarn"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            shared_dir(Fake)


TALK = "“走吧走吧。”林砚说道。“走吧走吧？”林砚说道。“好的呀！”苏疏笑道。" + "夜色沉沉。" * 210 + "“走吧走吧。”林砚说道。“好的呀！”苏疏笑道。“好的呀！！！”苏疏笑道。"


def test_voices(spark):
    df = spark.createDataFrame([(1, TALK), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.speaker, r.word, r.n) for r in voices.opening_words(df, "doc_id", "text").orderBy("speaker").collect()] == [("林砚", "走吧", 3), ("苏疏", "好的", 3)]
    assert ("林砚", "走吧", 6) in {(r.speaker, r.word, r.n) for r in voices.fixed_phrases(df, "doc_id", "text").collect()}
    assert {(r.tag, r.speaker, r.n) for r in voices.unique_tags(df, "doc_id", "text").collect()} == {("说道", "林砚", 3), ("笑道", "苏疏", 3)}
    assert {(r.confidence, r.speaker, r.lines) for r in voices.speaker_lists(df, "doc_id", "text").collect()} == {("high", "林砚", 3), ("high", "苏疏", 3)}
    assert {(r.kind, r.content) for r in voices.exemplars(df, "doc_id", "text").collect()} == {("overdone", "好的呀！！！")}
    assert voices.tag_ratio(df, "doc_id", "text").first().dao == 6 and voices.semantic_dimensions(df, "doc_id", "text").count() == 3


def test_tagged_measures(spark):
    rows = [(1, i + 1, w, f) for i, (w, f) in enumerate([("林砚", "nr")] * 7 + [("灵石", "nz")] * 6 + [("跑", "v"), ("很", "d"), ("山门", "ns"), (" ", "x"), ("好", None)])] + [(2, i, f"器{chr(0x4E00 + i // 6)}", "nz") for i in range(6 * 32)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, word string, flag string")
    one = ratios.pos_shares(tokens, "doc_id").where("doc_id = 1").first()
    assert (one.verb_ratio, one.adverb_ratio, one.content_words) == (0.5, 0.5, 2)
    names = ratios.entities(tokens, "doc_id").where("doc_id = 1").first()
    assert (names.person, names.place, names.other, names.entities) == (7, 1, 6, 14)
    assert [(r.kind, r.word) for r in ratios.entity_samples(tokens, "doc_id").where("doc_id = 1").orderBy("kind").collect()] == [("other", "灵石"), ("person", "林砚"), ("place", "山门")]
    found = ratios.worldview(tokens, "doc_id").collect()
    assert {(r.category, r.word, r.n) for r in found if r.doc_id == 1} == {("核心角色", "林砚", 7), ("核心设定", "灵石", 6)}
    assert [sum(r.category == c for r in found if r.doc_id == 2) for c in ("核心设定", "力量体系", "组织势力")] == [10, 10, 10]


def test_scenes(spark):
    text = "前文日常\n---\n# 场景2：冲突\n打斗\n===\n\n结尾"
    df = spark.createDataFrame([(1, text), (2, None), (3, "---\n---"), (4, "# 场景")], "doc_id long, text string")
    rows = {(r.doc_id, r.scene): r.text for r in fidelity.scene_texts(df, "doc_id", "text").collect()}
    assert rows == {(1, 1): "前文日常", (1, 2): "# 场景2：冲突\n\n打斗", (1, 3): "结尾", (4, 1): "# 场景"}
    checks = {r.doc_id: r for r in fidelity.scene_checks(df, "doc_id", "text").collect()}
    assert (checks[1].n_scenes, checks[1].short_scenes, checks[1].missing_types, checks[1].meets) == (3, 3, "抉择", False) and checks[2].missing_types is None and checks[4].missing_types is None


def test_longest_shared_stretch(spark):
    rng = random.Random(7)
    texts = [(i, "".join(rng.choices("甲乙", k=rng.choice([0, 1, 30, 90])))) for i in range(20)] + [(99, None)]
    refs = [("".join(rng.choices("甲乙", k=60)),) for _ in range(3)] + [(None,), ("",)]

    def brute(t):
        return max((n for r, in refs for n in range(len(t or "") + 1) if any((t or "")[a : a + n] in (r or "") for a in range(len(t or "") - n + 1))), default=0)

    df, rf = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(refs, "r string")
    for most in (10_000, 50):
        assert {r.id: r.longest for r in fidelity.longest_shared(df, "id", "t", rf, "r", most).collect()} == {i: brute(t) for i, t in texts}
    assert {r.longest for r in fidelity.longest_shared(df, "id", "t", rf.limit(0), "r").collect()} == {0}


def test_identity(spark):
    line = "前 [E1] “甲说“好”乙”（度量）— 注解：看“丙” [E2] “丁” 尾"
    got = spark.createDataFrame([(line,), ("无锚点“原样”",), (None,)], "t string").select(identity.masked_quotes(F.col("t"), "＊").alias("m")).collect()
    assert [r.m for r in got] == ["前 [E1] “＊”（度量）— 注解：看“丙” [E2] “＊” 尾", "无锚点“原样”", None]
    record = json.dumps({"name": "林砚录", "evidence": [{"quote": "林砚", "note": "林砚说"}], "discarded_candidates": ["林砚"], "desensitization_map": {"林砚": "旧人"}, "a": {"林砚": 1}}, ensure_ascii=False)
    strings = identity.json_strings(spark.createDataFrame([(1, "w", record), (2, "w", "{"), (3, "w", None)], "id long, work_id string, j string"), ["id", "work_id"], "j")
    known = spark.createDataFrame([("w", "林砚"), ("w", "砚"), ("v", "旧人")], "work_id string, term string")
    assert sorted((r.path, r.term) for r in identity.record_leaks(strings, "id", known).collect()) == [(".a.林砚", "林砚"), (".evidence[0].note", "林砚"), (".name", "林砚")]
    mapping = spark.createDataFrame([("w", "林砚", "林砚"), ("w", "砚台", ""), ("w", " ", "x"), ("w", "山门", "林砚之门外人")], "work_id string, original string, replacement string")
    assert sorted((r.original, r.problem) for r in identity.mapping_problems(mapping, known).collect()) == [("", "empty_key"), ("山门", "label_length"), ("山门", "leak"), ("山门", "unknown"), ("林砚", "identity"), ("砚台", "empty_value"), ("砚台", "unknown")]


def test_volumes_and_samples(spark):
    rows = [("w", "c1", 1, 0, "第一卷 起\n第1章 甲\n正文\n第2章 乙\n", "e", 1), ("w", "c2", 2, 24, "正文正文\n第二卷\n第3章 丙\n尾", "e", 1)]
    rows[1] = (*rows[1][:3], len(rows[0][4]), *rows[1][4:])
    chunks = spark.createDataFrame(rows, CHUNKS)
    assert [(r.chapter_idx, r.volume) for r in structure.chapter_volumes(chunks).orderBy("chapter_idx").collect()] == [(0, "第一卷"), (1, "第一卷"), (2, "第二卷")]
    whole = rows[0][4] + rows[1][4]
    spans = [(0, 10), (10, 30), (30, len(whole))]
    chapters = spark.createDataFrame([("w", f"C{i}", i, i + 1, "题", None if i else "第一卷", a, b, b - a) for i, (a, b) in enumerate(spans)], "work_id string, chapter_id string, chapter_idx int, chapter_no int, title string, volume string, start_pos long, end_pos long, n_chars long")
    assert structure.sampled_texts(chapters, chunks).first().sampled_text == "\n\n".join(whole[a:b] for a, b in spans)
    assert structure.plan_summary(chapters).first().sampled_chars == len(whole) + 4
    assert {r.range for r in structure.plan_ranges(chapters).collect()} == {"第一卷 第1~1章", "第2~2章", "第3~3章"}


def test_imagery(spark):
    text = "灯火摇曳，灯火通明。" * 12 + "林砚来，" * 15 + "好的呀，" * 20
    df = spark.createDataFrame([(1, text), (2, None), (3, "灯火，" * 9)], "doc_id long, text string")
    names = spark.createDataFrame([(1, "林砚")], "doc_id long, speaker string")
    rows = [(r.rank, r.word, r.n) for r in tokenizer.imagery(df, "doc_id", "text", names=names).orderBy("rank").collect()]
    # phrases are read without overlap, three characters at a time where they can be
    assert rows == [(1, "灯火摇", 12), (2, "灯火通", 12)]
    assert tokenizer.chosen("灯火摇曳" * 3, ["灯火摇", "火摇曳", "曳"], 8) == [0, 2]
    assert tokenizer.imagery(df.limit(0), "doc_id", "text").count() == 0


def test_dictionary_file_and_user_words(spark, tmp_path):
    (tmp_path / "d.txt").write_text("中国 50 ns\n中国人 20 n\n\n人民 60\n", encoding="utf-8")
    words = tokenizer.dictionary_file(spark, str(tmp_path / "d.txt"))
    assert sorted(tuple(r) for r in words.collect()) == [("中国", 50, "ns"), ("中国人", 20, "n"), ("人民", 60, None)]
    user = spark.createDataFrame([("人民", 0, None), ("民国", None, "t"), ("中国", 70, "n")], "word string, freq int, tag string")
    assert sorted(tuple(r) for r in tokenizer.with_user_words(words, user).collect()) == [("中国", 70, "n"), ("中国人", 20, "n"), ("民国", 1, "t")]
    (tmp_path / "bad.txt").write_text("中国 x n\n", encoding="utf-8")
    with pytest.raises(Exception, match="no dictionary entry"):
        tokenizer.dictionary_file(spark, str(tmp_path / "bad.txt")).collect()


def test_cut_takes_the_most_probable_path():
    rng = random.Random(11)
    words = tokenizer.Words([("".join(rng.choices("甲乙丙", k=rng.randint(1, 4))), rng.randint(1, 50), "n") for _ in range(25)])

    def score(parts):
        return sum(next((w for _, (size, w) in words.automaton.iter(p) if size == len(p)), words.floor if len(p) == 1 else -1e9) if p in words.tag else words.floor if len(p) == 1 else -1e9 for p in parts)

    def paths(run):
        return [[]] if not run else [[run[:k], *rest] for k in range(1, min(4, len(run)) + 1) for rest in paths(run[k:])]

    for _ in range(30):
        run = "".join(rng.choices("甲乙丙丁", k=rng.randint(1, 8)))
        assert "".join(words.cut(run)) == run and abs(score(words.cut(run)) - max(map(score, paths(run)))) < 1e-9


def test_records(spark, tmp_path):
    answer = 'Prose one\n```json\n{"a": 1}\n```\nmore\n```json\n{"technique_cards": [1]}\n```\nend'
    rows = [(1, answer), (2, 'Only\n{"technique_cards": []} '), (3, "no block"), (4, "```json\n{broken\n}\n``` x"), (5, None), (6, "```json\n[1]\n```")]
    out = {r.id: (r.prose, r.record) for r in records.parsed_answers(spark.createDataFrame(rows, "id long, t string"), ["id"], "t").collect()}
    assert out[1] == ('Prose one\n```json\n{"a": 1}\n```\nmore\n\nend', '{"technique_cards": [1]}') and out[2] == ("Only", '{"technique_cards": []}') and out[3] == ("no block", None)
    assert out[4] == (rows[3][1], None) and out[5] == (None, None) and out[6] == (rows[5][1], None)
    table = records.markdown_table(spark.createDataFrame([(2, "b|c"), (1, None)], "n int, t string"), ["n", "t"], ["n"]).first().table
    assert table == "| n | t |\n| --- | --- |\n| 1 |  |\n| 2 | b\\|c |"
    (tmp_path / "r.json").write_text('[{"n": 1},\n {"n": 2}]')
    assert sorted(r.n for r in records.read_json(spark, str(tmp_path), "n long").collect()) == [1, 2]
    assert records.in_memory(spark, [("t", "x" * 60)]).count() == 1
    with pytest.raises(Exception, match="fewer than 50"):
        records.in_memory(spark, [("t", " x ")]).collect()


def test_placeholders_and_claims(spark):
    values = spark.createDataFrame([(1, "M010", "avg_sent_len", 20.5), (1, "M001", "total_chars", 1200.0), (1, "M045", "punc_dash", 0.0)], "doc_id long, mid string, token string, value double")
    texts = spark.createDataFrame([(1, "{{avg_sent_len}} {{metric:M001|total_chars}} {{nope}} {{nope}} {{punc_dash}}"), (2, None), (3, "{{avg_sent_len}}")], "doc_id long, t string")
    assert {r.doc_id: (r.text, r.unresolved) for r in report.filled(texts, "doc_id", "t", values).collect()} == {1: ("20.5 1200 {{nope}} {{nope}} 0", "{{nope}}"), 2: ("", ""), 3: ("{{avg_sent_len}}", "{{avg_sent_len}}")}
    claims = spark.createDataFrame([(1, "平均句长 21 字\n平均句长为 25.5 字，总字符数 1,300 字\n[E1] 平均句长 90 字"), (2, "平均句长 3 字")], "doc_id long, t string")
    assert sorted((r.token, r.written, r.severity) for r in report.audit(claims, "doc_id", "t", values).collect()) == [("avg_sent_len", "25.5", "error"), ("total_chars", "1,300", "warning")]
    labels = spark.createDataFrame([("平均句长",), (" PUNC_DASH ",), ("short_sent_ratio_pct",), ("无",), ("",), (None,)], "m string").select(report.metric_token(F.col("m")).alias("t")).collect()
    assert [r.t for r in labels] == ["avg_sent_len", "punc_dash", "short_sent_ratio", None, None, None]


def test_answer_health(spark):
    body = "\n".join(f"### 1.{i} 节\n正文正文正文{i}" for i in range(1, 12))
    good = f"## 第〇部分\n概要\n## 第一部分 量\n{body}\n## 第二部分\n{'长' * 1000}\n## 第三部分\n末"
    bad = good.replace("### 1.3 节\n正文正文正文3\n", "").replace("正文正文正文11", "短").replace("## 第三部分", "**第三部分**")
    rows = {r.id: r for r in report.answer_health(spark.createDataFrame([(1, good), (2, bad), (3, None)], "id long, t string"), "id", "t").collect()}
    assert rows[1].healthy and (rows[2].missing_parts, rows[2].missing_sections, rows[2].short_sections, rows[2].healthy) == ("第三部分", 1, 1, False)
    assert (rows[3].missing_sections, rows[3].prose_chars) == (11, 0)
