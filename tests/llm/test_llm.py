"""Text operators for training data: brute force, round trips, held-out accuracy and edge cases on small inputs."""

from __future__ import annotations

import random
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from inkmill.functions.codepoints import decode, encode
from inkmill.llm import containers, leakage, lookalike_text, scan_noise, sentences, splitting, subjects

STORE = "work_id string, chunk_id string, start_pos long, chunk_text string, origin string, ingested_at long, extra string"


def test_codepoint_round_trip():
    column = pa.array(["a", "", None, "林😀é", "x" * 5])
    points, offsets = decode(column)
    assert encode(points, offsets, np.asarray(column.is_null())).to_pylist() == column.to_pylist()
    assert decode(column.slice(2, 2))[1].tolist() == [0, 0, 3]
    assert decode(pa.array([], pa.string()))[1].tolist() == [0]


# problem 2
@pytest.mark.parametrize("a,b,same", [
    ("Hаd​ Garisstan", "Had Garisstan", True), ("ＡＢ１", "AB1", True), ("café", "café", True), ("⻋⼝", "车口", True), ("ﬁn", "fin", True), ("a b", "a b", True), ("한", "한", True),
    ("a", "A", False), ("é", "e", False), ("，", "、", False), ("①", "1", False), ("叹道", "叹忽", False), ("...", "…", False),
])
def test_lookalikes(a, b, same):
    x, y = lookalike_text.canonical_array(pa.array([a, b])).to_pylist()
    assert (x == y) is same


def test_canonical_agrees_with_unicode_composition():
    random.seed(1)
    pool = [chr(c) for c in [*range(0xC0, 0x180), *range(0x300, 0x315), *range(0x61, 0x7B), 0x1EA5, 0x1E69, 0x323]]
    texts = ["".join(random.choices(pool, k=random.randint(0, 12))) for _ in range(300)]
    keep = [t for t in texts if not any(unicodedata.decomposition(c).startswith("<") for c in t)]
    got = lookalike_text.canonical_array(pa.array(keep)).to_pylist()
    assert got == [unicodedata.normalize("NFC", t) for t in keep]


def test_lookalike_pairs(spark):
    rows = [(1, "w", "Had it"), (2, "w", "Hаd it"), (3, "w", "Had it"), (4, "v", "Hаd it"), (5, "w", None), (6, "w", "​"), (7, None, "Hаd it"), (2, "w", "Hаd it")]
    df = spark.createDataFrame(rows, "item_id long, work_id string, quote string")
    assert sorted(map(tuple, lookalike_text.lookalike_pairs(df, "item_id", "work_id", "quote").collect())) == [(1, 2), (2, 3)]
    assert lookalike_text.lookalike_pairs(df.limit(0), "item_id", "work_id", "quote").count() == 0
    classes = sorted((r.item_id, r.class_id, r.n_links) for r in lookalike_text.look_classes(df, "item_id", "work_id", "quote").collect())
    assert classes == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 4, 0)] and lookalike_text.look_classes(df.limit(0), "item_id", "work_id", "quote").count() == 0


def test_links_of_classes_are_the_pairs(spark):
    random.seed(12)
    rows = [(i, random.choice("vw"), random.choice(["Had it", "Hаd it", "Ｈad it", "no", "nо", "yes"]), random.randint(0, 2)) for i in range(60)]
    df = spark.createDataFrame(rows + [(r[0], r[1], "no", 9) for r in rows[:5]], "item_id long, work_id string, quote string, ingested_at long")
    pairs = [tuple(r) for r in lookalike_text.lookalike_pairs(df, "item_id", "work_id", "quote", "ingested_at").collect()]
    last = {r[0]: (r[1], "no" if r[0] < 5 else r[2]) for r in rows}
    look = lambda t: t.replace("а", "a").replace("Ｈ", "H").replace("о", "o")
    brute = {(a, b) for a in last for b in last if a < b and last[a][0] == last[b][0] and last[a][1] != last[b][1] and look(last[a][1]) == look(last[b][1])}
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute
    links = {r.item_id: r.n_links for r in lookalike_text.look_classes(df, "item_id", "work_id", "quote", "ingested_at").collect()}
    assert links == {i: sum(i in p for p in pairs) for i in last}


# problem 5
@pytest.mark.parametrize("text,expected", [
    ("", []), ("  \n* * *\n", []), ("第2章 孤城\n他走了。她来了", ["第2章 孤城", "他走了。", "她来了"]),
    ("“消息是假的。”娄霁汐笑道。他走了！", ["“消息是假的。”娄霁汐笑道。", "他走了！"]), ("“别回头！”甲叹道，“走。”“好。”", ["“别回头！”甲叹道，“走。”", "“好。”"]), ("“走！”乙笑道：“好。来。”", ["“走！”", "乙笑道：“好。来。”"]),
    ("甲（笑了。真的）走了。乙……停下，看。约38.6里。", ["甲（笑了。真的）走了。", "乙……停下，看。", "约38.6里。"]), ("Dr. Ash met J. K. Low at 5 p.m. The end. Had he?!", ["Dr. Ash met J. K. Low at 5 p.m.", "The end.", "Had he?!"]),
    ("“Go. Now!” said Ann. Bob left.", ["“Go. Now!” said Ann.", "Bob left."]), ("Am 12. Mai ging er, d. h. heim. Gut.", ["Am 12. Mai ging er, d. h. heim.", "Gut."]), ("「遅い。来い！」と彼は言った。雪。", ["「遅い。来い！」と彼は言った。", "雪。"]),
    ("“टूट गया। रुको!” मेघिका ने कहा। डॉ. वेद गया।", ["“टूट गया। रुको!” मेघिका ने कहा।", "डॉ. वेद गया।"]), ("เกศขาย 3 ชิ้น ธารินลืม", ["เกศขาย 3 ชิ้น", "ธารินลืม"]), ("“没有收尾。他走了。\n好。", ["“没有收尾。", "他走了。", "好。"]),
])
def test_sentences(text, expected):
    starts = sentences.starts_array(pa.array([text])).to_pylist()[0]
    assert [text[a - 1 : b - 1].strip().split("\n")[0] for a, b in zip(starts, [*starts[1:], len(text) + 1])] == expected


def test_many_unclosed_marks_in_a_line():
    for n in (1, 6, 7, 8, 30):
        text = "“好，" * n + "他走了。她来了。\n好。"
        starts = sentences.starts_array(pa.array([text])).to_pylist()[0]
        assert [text[a - 1] for a in starts] == ["“", "她", "好"]


def test_prefix_scan_equals_stepping():
    t = sentences.transducer()
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000, 5000):
        letters = rng.integers(0, len(t.step), n).astype(np.uint8)
        state, expected = 0, []
        for x in letters:
            expected.append(state)
            state = t.step[x, state]
        assert t.run(letters).tolist() == expected


# problem 4
def test_bisection_limits_overlap_and_round_trip():
    random.seed(2)
    alphabet = "字句。，\n 　a1"
    for n in (0, 1, 2400, 2401, 5000, 40000):
        for text in ("x" * n, "".join(random.choices(alphabet, k=n))):
            points, offsets = decode(pa.array([text]))
            pieces = splitting.pieces_of(points, offsets, 2400, 100, 200)[0]
            assert bool(pieces) == bool(n)
            at = 0
            for k, (a, b) in enumerate(pieces):
                assert b - a <= 2400
                if k:
                    assert 100 <= at - a <= 200
                at = b
            assert at == n


def test_assign_pieces(spark):
    text = "。".join(f"第{i}句话说得很长很长" for i in range(600))
    other = "。".join(f"那{i}盏灯照着河边的路" for i in range(600))
    rows = [("w", "c001", 1, text, 1), ("w", "c001", 1, text, 2), ("w", "c002", 2, "短句子在这里面", 1), ("w", "c003", 3, None, 1), ("w", "c004", 4, other, 1), ("w", "c005", 5, other, 1)]
    store = spark.createDataFrame([(w, c, s, 0, t, "web", n, "") for w, c, s, t, n in rows], "work_id string, chunk_id string, seq int, start_pos long, chunk_text string, origin string, ingested_at long, extra string")
    items = [(1, " C001 ", "第５９９句话"), (2, "c001", "没有这样的一句话"), (3, "c002", "短句子在这里面"), (4, None, None), (5, "c001", "那599盏灯，照着河边"), (6, "c001", "第300句话說得很長很长。第301句话"), (7, "c001", "短句子在这里面"), (8, "c999", "那3盏灯照着河边"), (9, "", "短句子在这里面"), (10, "c004", "灯"), (11, "c001", text[1000:2900])]
    df = spark.createDataFrame([(i, "w", c, q, 1) for i, c, q in items], "item_id long, work_id string, chunk_id string, quote string, ingested_at long")
    rows = {r.item_id: r for r in splitting.assign_pieces(store, df).collect()}
    pieces = splitting.split(splitting.oversized(store, 2400), "chunk_text", ["work_id", "chunk_id"]).where("chunk_id = 'c001'").collect()
    assert {i: (r.chunk_id, r.match) for i, r in rows.items()} == {1: ("c001", "exact"), 2: ("c001", None), 5: ("c004", "moved"), 6: ("c001", "near"), 7: ("c002", "moved"), 8: ("c004", "moved"), 10: ("c004", "exact"), 11: ("c001", "exact")}
    assert rows[1].piece_no == pieces[0].n_pieces and rows[2].piece_no is None and rows[7].piece_no == 1
    held = next(p for p in pieces if p.piece_no == rows[6].piece_no)
    assert "第300句" in held.piece_text and "第301句话" in held.piece_text and text[rows[1].quote_pos - 1 :].startswith("第599句")
    assert splitting.assign_pieces(store, df.limit(0)).count() == 0 and splitting.assign_pieces(store.limit(0), df).count() == 0


# problem 6
def least_bins(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_inputs():
    random.seed(5)
    for _ in range(150):
        capacity = random.choice([10, 30, 100])
        sizes = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 8))), reverse=True)
        bins = containers.complete(sizes, capacity)
        assert sorted(x for b in bins for x in b) == sorted(sizes) and max(map(sum, bins)) <= capacity
        assert len(bins) == least_bins(sizes, capacity)
    assert containers.complete([], 10) == [] and containers.complete([0, 0], 10) == [[0, 0]]


def test_fillings_are_the_undominated_ones():
    from itertools import combinations

    def sub(items, size):
        return {tuple(sorted(c, reverse=True)) for c in combinations(items, size)}

    assert containers.fillings(containers.Room([10, 9], 11), 11, 11) == [(10,)]
    random.seed(15)
    for _ in range(200):
        free = random.randint(3, 24)
        sizes = [random.randint(1, 14) for _ in range(random.randint(1, 8))]
        all_ = {f for k in range(len(sizes) + 1) for f in sub(sizes, k) if sum(f) <= free}

        def worse(f, sizes=sizes, free=free):  # another item can be added, or take the place of some for more or of several for as much
            rest, waste = list(sizes), free - sum(f)
            for s in f:
                rest.remove(s)
            groups = [()] + [g for k in range(1, len(f) + 1) for g in combinations(f, k)]
            return any(sum(g) <= x <= sum(g) + waste and (x > sum(g) or len(g) > 1) for g in groups for x in rest)

        got = containers.fillings(containers.Room(sizes, 30), free, free)
        assert len(got) == len(set(got)) and set(got) == {f for f in all_ if not worse(f)}


def test_search_improves_on_best_fit():
    random.seed(14)
    better = 0
    for _ in range(60):
        sizes = [random.randint(18, 60) for _ in range(14)]
        first, limited, exact = containers.best_fit(sizes, 100), containers.complete(sizes, 100), containers.complete(sizes, 100, containers.EXACT)
        assert len(exact) == least_bins(sorted(sizes, reverse=True), 100) and len(exact) <= len(limited) <= len(first)
        better += len(exact) < len(first)
    assert better > 0


def test_containers(spark):
    docs = spark.createDataFrame([(i, "词语很多。" * (i * 40), None) for i in range(40)] + [(100, None, "x"), (101, "", "x")], "doc_id long, text string, n_tokens string")
    rows = containers.containers(docs).collect()
    fill: dict[str, int] = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 2048 and {r.doc_id for r in rows} == {*range(40), 100, 101}
    sizes = {r.doc_id: r.n_tokens for r in containers.token_counts(docs.select("doc_id", "text"), "doc_id", "text").collect()}
    for d, n in sizes.items():
        mine = [r for r in rows if r.doc_id == d]
        assert sum(r.n_tokens for r in mine) == n and (len(mine) == 1 or n > 2048)
    assert containers.containers(docs.limit(0)).count() == 0


# problem 7
def test_leaks(spark):
    random.seed(6)
    han = [chr(c) for c in range(0x4E00, 0x5200)]
    passage = "".join(random.choices(han, k=120))
    noise = lambda n: "".join(random.choices(han, k=n))
    changed = list(passage[20:90])
    for k in (15, 40, 60):
        changed[k] = "龘"
    docs = [(1, noise(300) + "，".join(passage[i : i + 7] for i in range(0, 120, 7)) + noise(50)), (2, noise(99) + "".join(changed) + noise(9)), (3, noise(50) + passage[10:50] + noise(80)), (4, None), (5, ""), (6, passage[:30] + noise(3) + passage[30:60])]
    items = [(7, "zh", passage), (8, "zh", passage), (9, "en", None), (10, "zh", "…")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    rows = leakage.leaks(d, i).collect()
    assert sorted({(r.doc_id, r.item_id) for r in rows}) == [(1, 7), (1, 8), (2, 7), (2, 8), (6, 7), (6, 8)]
    one = next(r for r in rows if r.doc_id == 1)
    assert docs[0][1][one.start_pos - 1] == passage[0] and docs[0][1][one.end_pos - 1] == passage[-1]
    assert leakage.leaks(d, i.limit(0)).count() == 0 and leakage.leaks(d.limit(0), i).count() == 0


def test_leaks_do_not_reach_into_the_next_document(spark):
    random.seed(16)
    passage = "".join(random.choices([chr(c) for c in range(0x4E00, 0x5200)], k=100))
    docs = spark.createDataFrame([(1, passage[:30]), (2, passage[31:61]), (3, passage[10:70])], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(7, "zh", passage)], "item_id long, lang string, text string")
    assert [(r.doc_id, r.start_pos, r.end_pos) for r in leakage.leaks(docs, items).collect()] == [(3, 1, 60)]
    built = leakage.Passages([(7, "text", passage, "zh")], leakage.LEAST, leakage.GRAM)
    for cut in range(20, 81):
        assert built.search(*decode(pa.array([passage[:cut], passage[cut + 1 :]]))) == [(r, 0, 0, n) for r, n in enumerate((cut, 99 - cut)) if n >= 50]


@pytest.mark.parametrize("lang,first,last,n", [("zh", 0x4E00, 0x9000, 300), ("en", 0x61, 0x7B, 500)])
def test_changed_characters_within_the_guarantee(lang, first, last, n):
    random.seed(17)
    letters = [chr(c) for c in range(first, last)]
    passage = "".join(random.choices(letters, k=n))
    built = leakage.Passages([(1, "text", passage, lang)], leakage.LEAST, leakage.GRAM)
    least = leakage.LEAST[lang]
    for turn in range(200):
        at = random.randrange(n - 2 * least)
        part = list(passage[at : at + least + 20])
        for k in random.sample(range(10, least + 10), least // 10) if turn else range(8, len(part) - 8, 9):
            part[k] = "龘" if lang == "zh" else "é"
        text = "".join(random.choices(letters, k=40)) + "".join(part) + "".join(random.choices(letters, k=40))
        assert built.search(*decode(pa.array([text]))), (turn, at)


def test_leaks_of_questions_in_blocks(spark):
    items = spark.createDataFrame([(1, "en", "the long passage of the test " * 8, "Who carried the lantern over the bridge?", "Zanithel"), (2, "en", None, None, None)], "item_id long, lang string, text string, question string, answer string")
    docs = spark.createDataFrame([(1, "He asked: who carried the LANTERN, over the bridge!"), (2, "It was Zanithel."), (3, "the long passage of the test " * 6), (4, "who carried the lantern")], "doc_id long, text string")
    for most in (150, 10_000):
        rows = leakage.leaks(docs, items, fields=("text", "question", "answer"), most_chars=most).collect()
        assert sorted({(r.doc_id, r.field) for r in rows}) == [(1, "question"), (2, "answer"), (3, "text")]


def test_shipped_words_fit_the_driver():
    n = scan_noise.MOST_ENTRIES
    table = pa.table({"w": [f"w{i:08d}" for i in range(n)], "n": [1] * n, "at": [1] * n, "size": [1] * n, "y": ["a"] * n})
    tracemalloc.start()
    lexicon = scan_noise.lexicon_of(scan_noise.Corpus({}, {}, None), scan_noise.rows_of(table))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(lexicon.words) == len(lexicon.readings) == n and most < 100e6


# problem 8
SUBJECT_TERMS = {s: [f"{s}word{chr(97 + k)}" for k in range(20)] for s in ("law", "music", "sport")}
FILLER = ["table", "river", "stone", "window", "garden", "letter", "candle", "road"]


def subject_doc(subject, share):
    out = []
    for _ in range(24):
        if subject and random.random() < share:
            out.append(f"The {random.choice(SUBJECT_TERMS[subject])} met the {random.choice(SUBJECT_TERMS[subject])} near the {random.choice(FILLER)}.")
        else:
            out.append(f"The {random.choice(FILLER)} stood by the {random.choice(FILLER)}.")
    return " ".join(out)


def subject_agreement():
    random.seed(8)
    train = [(s, subject_doc(s, 0.6)) for _ in range(60) for s in (*SUBJECT_TERMS, None)]
    model = subjects.fit([t for _, t in train], [{s or "general"} for s, _ in train], [*SUBJECT_TERMS, "general"])
    test = [(s, subject_doc(s, 0.5)) for _ in range(15) for s in (*SUBJECT_TERMS, None)]
    points, offsets = decode(pa.array([t for _, t in test]))
    found, total = model.mixtures(points, offsets)
    got = [{model.subjects[k] for k in np.flatnonzero(f >= 0.15 * n)} for f, n in zip(found, total)]
    return sum(g == ({s} if s else set()) for g, (s, _) in zip(got, test)) / len(test)


def test_leaves_hold_out():
    assert subject_agreement() >= 0.9


def test_subjects_come_from_the_leaves(monkeypatch):
    monkeypatch.setattr(subjects, "bisect", lambda vectors, leaves: np.random.default_rng(0).integers(0, leaves, len(vectors)))
    assert subject_agreement() < 0.5


def test_mixture_of_two_subjects():
    random.seed(9)
    train = [(s, subject_doc(s, 0.6)) for _ in range(60) for s in (*SUBJECT_TERMS, None)]
    model = subjects.fit([t for _, t in train], [{s or "general"} for s, _ in train], [*SUBJECT_TERMS, "general"])
    points, offsets = decode(pa.array([subject_doc("law", 0.9) + " " + subject_doc("sport", 0.9)]))
    found, total = model.mixtures(points, offsets)
    assert {model.subjects[k] for k in np.flatnonzero(found[0] >= 0.15 * total[0])} == {"law", "sport"}


def test_all_documents_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(subjects, "sample", lambda *a: pytest.fail("fitted on a sample"))
    random.seed(10)
    kinds = [s for _ in range(80) for s in (*SUBJECT_TERMS, None)]
    docs = spark.createDataFrame([(i, subject_doc(s, 0.6)) for i, s in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, s or "general") for i, s in enumerate(kinds) if i % 3], "doc_id long, subject string")
    names = spark.createDataFrame([(s,) for s in (*SUBJECT_TERMS, "general")], "subject string")
    got = {(r.doc_id, r.subject) for r in subjects.subject_areas(docs, labels, names).collect()}
    assert len(got & {(i, s or "general") for i, s in enumerate(kinds)}) >= 0.9 * max(len(got), len(kinds))


def test_identical_texts_share_their_labels(spark):
    docs = spark.createDataFrame([(1, "a text", 0), (2, "a text", 0), (3, "x" * 50, 0), (4, None, 0)], "doc_id long, text string, subject int")
    labels = spark.createDataFrame([(1, " LAW "), (2, "music"), (3, "law"), (9, "law"), (None, "law")], "doc_id long, subject string")
    assert subjects.sample(docs, labels, ["law", "music"], 10, 40) == (["a text"], [{"law", "music"}])


def test_terms_of_sentences_are_kept_as_bytes(spark):
    random.seed(11)
    texts = [subject_doc(s, 0.6) for _ in range(20) for s in (*SUBJECT_TERMS, None)] + [None, "", "x " * 5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, "law")], "doc_id long, subject string")
    coded, _ = subjects.corpus_model(docs, labels, [*SUBJECT_TERMS, "general"])
    assert not [kind for _, kind in coded.dtypes if kind.startswith("array")]  # lists cost a call per value in every pass
    points, offsets = decode(pa.array(texts, pa.string()))
    codes = np.unique(subjects.grams(points)[0])[::2]
    sentence, term, row = subjects.pairs(points, offsets, subjects.Lookup(codes))
    whole = pa.RecordBatch.from_arrays(subjects.packed(sentence, term, row, len(texts)), [*subjects.PACKED])
    for a, b in ((0, len(texts)), (7, 31), (80, len(texts))):
        mine = (row[sentence] >= a) & (row[sentence] < b)
        own = subjects.sentences_of(whole.slice(a, b - a), 0)
        assert own[0].tolist() == (sentence[mine] - np.searchsorted(row, a)).tolist() and own[1].tolist() == term[mine].tolist()
        assert own[2].tolist() == (row[(row >= a) & (row < b)] - a).tolist()
    high = np.array([0, 65535, 65536, 3 << 20])
    assert subjects.sentences_of(pa.RecordBatch.from_arrays(subjects.packed(np.zeros(4, np.int64), high, np.zeros(1, np.int64), 1), [*subjects.PACKED]), 0)[1].tolist() == high.tolist()


def test_lookup_finds_codes_that_share_a_slot():
    rng = np.random.default_rng(1)
    for n in (1, 40, 5000):
        codes = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        lookup = subjects.Lookup(codes)
        asked = np.concatenate((codes, codes + 1, rng.integers(-(1 << 62), 1 << 62, 3000)))
        known, place = lookup.find(asked)
        assert known.tolist() == np.flatnonzero(np.isin(asked, codes)).tolist() and (codes[place] == asked[known]).all()
    assert (lookup.table == -2).any()


@pytest.mark.parametrize("leaves", [1, 2, 9])
def test_leaf_that_the_other_terms_speak_for(leaves):
    rng = np.random.default_rng(2)
    weights = rng.integers(-8, 13, (50, leaves)).astype(np.float32) / 4  # sums are exact, ties are many
    named = rng.random(50) < 0.7
    sentence, term = np.divmod(np.flatnonzero(rng.random(300 * 50) < np.repeat(rng.random(300) ** 3, 50)), 50)
    got = subjects.led(sentence, term, np.flatnonzero(named[term]), weights, weights.min(1), block=70)
    for s, t, leaf in zip(sentence.tolist(), term.tolist(), got.tolist()):
        others = [u for u in term[sentence == s].tolist() if named[u] and u != t]
        score = weights[others].sum(0) if others else np.zeros(leaves)
        assert leaf == (score.argmax() if score.max() > 1 else leaves)


def test_vectors_are_sent_in_pieces():
    rng = np.random.default_rng(3)
    for size in (1, 700, 900_000):
        at = np.flatnonzero(rng.random(size) < 0.4)
        value = rng.random(len(at)).astype(np.float32)
        sent = [subjects.cells(b) for b in subjects.in_pieces(at, value)]
        assert np.concatenate([i for i, _ in sent] or [[]]).tolist() == at.tolist() and np.concatenate([v for _, v in sent] or [[]]).tolist() == value.tolist()


def test_subjects_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "一句。"), (3, "一句。")], "doc_id long, text string")
    labels = spark.createDataFrame([], "label_id long, doc_id long, subject string")
    names = spark.createDataFrame([("law",), ("general",), (None,)], "subject string")
    assert sorted((r.doc_id, r.subject) for r in subjects.subject_areas(docs, labels, names).distinct().collect()) == [(1, "general"), (2, "general"), (3, "general")]


# problem 1
def test_scan_noise(spark):
    body = ["山门夜雨连绵不绝他提着灯走过长廊心里想着旧事", "一路上没有人说话只有雨声敲打屋檐像旧年的更鼓"]
    text = "\n".join([*body, "灰塔长歌", *body, "- 12 -", *body, "灰塔长歌", *body, "- 13 -", *body])
    clean = "\n".join(body * 4)
    latin = "He walked home slowly and the oth-\ners looked away from the window now\nwhile the others went to the garden and the\nothers stayed with the others for a while."
    rows = [("w", "c1", 0, text, "scan", 1, ""), ("w", "c2", 1, clean, "ebook", 1, ""), ("w", "c3", 2, latin, "scan", 1, ""), ("w", "c3", 2, latin, "scan", 2, ""), ("w", "c4", 3, None, None, 1, ""), ("w", "c5", 4, "", None, 1, "")]
    store = spark.createDataFrame(rows, STORE)
    works = spark.createDataFrame([("w", "灰塔长歌", None)], "work_id string, title string, author_name string")
    chapters = spark.createDataFrame([], "work_id string, chapter_no int, title string, is_fallback boolean")
    for most in (None, 0):  # shipped, and joined to the chunks
        kinds = sorted((r.chunk_id, r.noise_kind) for r in scan_noise.noise_kinds(store, works, chapters, most_entries=most).collect())
        assert kinds == [("c1", "header"), ("c1", "page_no"), ("c3", "hyphen")]
    fixed = {r.chunk_id: r.repaired for r in scan_noise.repair(store, works, chapters).collect()}
    assert "灰塔" not in fixed["c1"] and "12" not in fixed["c1"] and "the others looked" in fixed["c3"] and fixed["c4"] is None and fixed["c5"] == ""


def test_scan_noise_edge_cases(spark):
    """Empty tables, null keys and texts, repeated rows, no origin column, a column named as one of the operator's own."""
    rows = [("w", "c1", "灰塔\n山门\n夜雨", 1), ("w", "c1", "灰塔\n山门\n夜雨", 1), (None, "c2", "x-\ny", 1), ("w", None, "x", 1), ("w", "c3", None, 1), ("w", "c4", "", 1)]
    store = spark.createDataFrame([(*r, 7, "k") for r in rows], "work_id string, chunk_id string, chunk_text string, ingested_at long, n long, w string")
    works = spark.createDataFrame([("w", None, None), (None, "灰塔", "灰塔")], "work_id string, title string, author_name string")
    chapters = spark.createDataFrame([("w", None, None, None)], "work_id string, chapter_no int, title string, is_fallback boolean")
    assert scan_noise.noise_kinds(store, works, chapters).count() == 0
    assert sorted((r.chunk_id, r.repaired, r.n_paragraphs) for r in scan_noise.repair(store, works, chapters).collect()) == [("c1", "灰塔山门夜雨", 1), ("c3", None, 0), ("c4", "", 0)]
    assert scan_noise.noise_kinds(store.limit(0), works.limit(0), chapters.limit(0)).count() == 0 and scan_noise.repair(store.limit(0), works, chapters).count() == 0


def test_scan_heads_as_long_as_the_text(spark):
    body = ["He walked home along the river and thought of", "the winter road while nobody in the house was", "awake and the lamps went out one by one until"]
    spaced = "T H E   P A I N T E D   W H I S T L E   O F   H O B B S W E L L"
    inside = [*body, "The Painted Whistle of Hobbswell | The Drum", *body, *body]
    long_ = [*body, spaced, *body, *body]
    divided = [*body[:2], "awake and the lamps went out and the oth-", "The Painted Whistle of Hobbswell | The Drum", "ers looked away from the window and said that", *body]
    same = [*body, "They met near the mill where nobody ever went", *body, "They met near the mill where nobody ever went", *body]
    page = [*body, "41", "A Long Head That No Table Of Titles Has", *body, "42", "A Long Head That No Table Of Titles Has", *body]
    store = spark.createDataFrame([("w", f"c{i}", i, "\n".join(x), "scan", 1, "") for i, x in enumerate((inside, long_, divided, same, page))], STORE)
    works = spark.createDataFrame([("w", "The Painted Whistle of Hobbswell", None)], "work_id string, title string, author_name string")
    chapters = spark.createDataFrame([], "work_id string, chapter_no int, title string, is_fallback boolean")
    kinds = sorted((r.chunk_id, r.noise_kind) for r in scan_noise.noise_kinds(store, works, chapters).collect())
    assert kinds == [("c0", "header"), ("c1", "header"), ("c2", "header"), ("c2", "hyphen"), ("c4", "header"), ("c4", "page_no")]
    fixed = {r.chunk_id: r.repaired for r in scan_noise.repair(store, works, chapters).collect()}
    assert "Whistle" not in fixed["c0"] and "T H E" not in fixed["c1"] and "the others looked" in fixed["c2"] and fixed["c3"].count("They met") == 2 and "Long Head" not in fixed["c4"]


def lexicon(words=None, readings=None, han=None, pairs=None):
    return scan_noise.Lexicon(words or {}, readings or {}, han or {}, pairs or {})


def test_misread_needs_evidence():
    known = lexicon(han={"孒": "了", "—": "一"}, pairs={"门了": 50, "了笑": 40, "看一": 9}, readings={"forgottcn": (7, 1, "e")})
    assert scan_noise.misread("门孒笑", known) == [(1, 2, "了")]
    assert scan_noise.misread("无孒证", known) == []
    assert scan_noise.misread("看—眼，看——眼", known) == [(1, 2, "一")]
    assert scan_noise.misread("he had Forgottcn it, ot■er", known) == [(7, 16, "Forgotten"), (23, 24, "")]


@pytest.mark.parametrize("scale", [1, 10])
def test_confusions_are_learned_from_the_corpus(spark, scale):
    random.seed(13)
    lines = [f"他{a}了{b}灯" for a, b in zip("走看听说问答", "东西南北上下")] + ["the winter house where others were gone with winter", "there were letters under the weather for others"]
    typed = [" ".join(random.sample(lines, 8) * 5) for _ in range(20 * scale)]
    wrong = [t.replace("了", "孒", 1).replace("where", "whcre", 1).replace("letters", "lettcrs", 1).replace("weather", "wcather", 1).replace("winter", "wintcr", 1) for t in typed[: 10 * scale]]
    rows = [("w", f"c{i}", i, t, o, 1) for i, (t, o) in enumerate([*((t, "ebook") for t in typed * 3), *((t, "scan") for t in wrong)])]
    chunks = spark.createDataFrame(rows, "work_id string, chunk_id string, start_pos long, chunk_text string, origin string, ingested_at long")
    corpus = scan_noise.learn(chunks)
    assert corpus.han == {"孒": "了"}
    assert {(r.w, r.y) for r in corpus.entries.where("y is not null").collect()} == {(w, "e") for w in ("whcre", "lettcrs", "wcather", "wintcr")}
    bare = scan_noise.learn(chunks.drop("origin").limit(0))
    assert bare.han == {} and bare.entries.count() == 0


@pytest.mark.parametrize("line,number", [("46", 46), ("- 183 -", 183), ("Page 7", 7), ("P.262", 262), ("第131页", 131), ("第 47 页 共 412 页", 47), ("263/412", 263), ("[129]", 129), ("三四二", 342), ("一百零五", 105), ("cccxlii", 342), ("十二", 12)])
def test_page_numbers(line, number):
    m = scan_noise.NUMBER.fullmatch(line)
    assert m and scan_noise.value(m["n"]) == number
