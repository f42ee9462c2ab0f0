"""SQL of the voices, ratios, cards, fidelity and identity queries, for an independent engine."""

from __future__ import annotations

from inkmill.functions import lexicons as L
from inkmill.plans import oracles as O
from inkmill.plans.oracles import DOCS, FUNCTION, QUOTED, chars, count, q, ratio, strip, total, words

SAID = O.SPEAKERS[: O.SPEAKERS.index(",\nt AS (SELECT doc_id, speaker, tag AS fav_tag")]
NORMAL = "row_number() OVER (PARTITION BY {} ORDER BY {})"


def rank(keys: str, order: str) -> str:
    return f"CAST({NORMAL.format(keys, order)} AS INTEGER) AS rank"


PHRASES = f"""{SAID}, tot AS (SELECT doc_id, speaker, count(*) AS lines FROM s GROUP BY ALL),
ru AS (SELECT doc_id, speaker, q_no, unnest(regexp_extract_all(content, {q(L.CJK + '{2,}')})) AS run, generate_subscripts(regexp_extract_all(content, {q(L.CJK + '{2,}')}), 1) AS r FROM s),
pa AS (SELECT doc_id, speaker, q_no, r, i, substr(run, i, 2) AS word FROM (SELECT *, unnest(range(1, length(run))) AS i FROM ru)),
ct AS (SELECT doc_id, speaker, word, count(*) AS n, min(q_no * 1000000000 + r * 100000 + i) AS first FROM pa GROUP BY ALL), rk AS (SELECT *, {rank('doc_id, speaker', 'n DESC, first')} FROM ct)
SELECT doc_id, speaker, rank, word, n FROM rk JOIN tot USING (doc_id, speaker) WHERE rank <= 10 AND n >= greatest(2, lines // 10)"""
OPENING = f"""{SAID}, w AS (SELECT doc_id, speaker, q_no, regexp_extract(content, {q(L.CJK + '{2}')}) AS word, count(*) OVER (PARTITION BY doc_id, speaker) AS lines FROM s),
ct AS (SELECT doc_id, speaker, word, count(*) AS n, min(q_no) AS first, max(lines) AS lines FROM w WHERE word <> '' GROUP BY ALL), rk AS (SELECT *, {rank('doc_id, speaker', 'n DESC, first')} FROM ct)
SELECT doc_id, speaker, rank, word, n FROM rk WHERE rank <= 10 AND n >= greatest(2, lines // 15)"""
TAGS3 = f"tg AS (SELECT * FROM (SELECT doc_id, speaker, tag, n, {rank('doc_id, speaker', 'n DESC, first')} FROM (SELECT doc_id, speaker, tag, count(*) AS n, min(q_no) AS first FROM s GROUP BY ALL)) WHERE rank <= 3)"
PROFILES = "pf AS (SELECT doc_id, speaker, count(*) AS lines, min(q_no) AS first, CASE WHEN count(*) >= 3 AND count(DISTINCT block) >= 2 THEN 'high' ELSE 'low' END AS confidence FROM s GROUP BY ALL)"
TAG_COUNTS = "tc AS (SELECT doc_id, tag, count(*) AS n, min(q_no) AS first FROM qq WHERE tag IS NOT NULL GROUP BY ALL)"
POV = f"""po AS (SELECT doc_id, {chars('clean', '我咱俺')} AS first_markers, {chars('clean', '他她它')} + {words('clean', ['他们', '她们'])} AS third_markers FROM base)"""
HEAPED = "(" + " + ".join(f"CAST(contains(content, {q(t)}) AS INT)" for t in L.DECORATIVE) + ")"
VOICES = {
    "fixed_phrases": PHRASES,
    "opening_words": OPENING,
    "common_tags": f"{SAID}, {TAGS3} SELECT doc_id, speaker, tag, n, rank FROM tg",
    "sample_quotes": f"{SAID} SELECT doc_id, speaker, rank, substr(content, 1, 50) AS quote FROM (SELECT *, {rank('doc_id, speaker', 'q_no')} FROM s) WHERE rank <= 3",
    "speaker_lists": f"{SAID}, {PROFILES} SELECT doc_id, confidence, rank, speaker, lines FROM (SELECT *, {rank('doc_id, confidence', 'lines DESC, first')} FROM pf) WHERE rank <= CASE confidence WHEN 'high' THEN 10 ELSE 20 END",
    "tag_frequencies": f"WITH {QUOTED}, {TAG_COUNTS} SELECT doc_id, rank, tag, n FROM (SELECT *, {rank('doc_id', 'n DESC, first')} FROM tc) WHERE rank <= 15",
    "tag_ratio": f"WITH {QUOTED}, r AS (SELECT doc_id, count(*) FILTER (WHERE right(tag, 1) = '道') AS dao, count(*) FILTER (WHERE right(tag, 1) = '说') AS shuo FROM qq WHERE tag IS NOT NULL GROUP BY 1) SELECT *, {ratio('dao', 'shuo')} AS dao_per_shuo FROM r",
    "unique_tags": f"""{SAID}, {TAGS3}, {PROFILES}, {TAG_COUNTS}, ow AS (SELECT doc_id, tag, min(speaker) AS speaker FROM tg JOIN pf USING (doc_id, speaker) WHERE confidence = 'high' GROUP BY ALL HAVING count(*) = 1)
SELECT doc_id, rank, tag, speaker, n FROM (SELECT ow.doc_id, ow.tag, ow.speaker, tc.n, {rank('ow.doc_id', 'tc.n DESC, encode(ow.tag)')} FROM ow JOIN tc ON tc.doc_id = ow.doc_id AND tc.tag = ow.tag) WHERE rank <= 10""",
    "function_shares": f"WITH {QUOTED}, f AS (SELECT doc_id, {FUNCTION} AS function, count(*) AS n FROM qq GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY doc_id) AS share FROM f",
    "semantic_dimensions": f"""WITH {QUOTED}, {POV}, f AS (SELECT doc_id, count(*) AS n_quotes, {', '.join(f"count(*) FILTER (WHERE {FUNCTION} = {q(n)}) AS f{i}" for i, (n, _) in enumerate(L.FUNCTIONS))} FROM qq GROUP BY 1)
SELECT doc_id, first_markers, third_markers, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['n_quotes', *[f'f{i}' for i in range(len(L.FUNCTIONS))]])},
 CASE WHEN first_markers + third_markers = 0 THEN 'none' WHEN first_markers * 10 > (first_markers + third_markers) * 6 THEN 'first' WHEN first_markers * 10 < (first_markers + third_markers) * 4 THEN 'third' ELSE 'mixed' END AS person,
 CASE WHEN first_markers + third_markers = 0 THEN 'none' WHEN 4 * greatest(first_markers, third_markers) > 3 * (first_markers + third_markers) THEN 'stable' ELSE 'shifting' END AS stability FROM po LEFT JOIN f USING (doc_id)""",
    "exemplars": f"""WITH {QUOTED}, k AS (SELECT doc_id, q_no, content, CASE WHEN {HEAPED} >= 2 OR {chars('content', '…')} >= 3 OR {chars('content', '！')} >= 3 THEN 'overdone' WHEN length(content) BETWEEN 6 AND 60 THEN 'fit' END AS kind FROM qq)
SELECT doc_id, kind, rank, content FROM (SELECT *, {rank('doc_id, kind', 'q_no')} FROM k WHERE kind IS NOT NULL) WHERE rank <= 5""",
}

D = "CAST({} AS DOUBLE)".format


def per(x: str) -> str:
    return f"({x}) * {D(1000)} / CAST(greatest(total_chars, 1) AS DOUBLE)"


QUOTED_CHARS = total(f"list_transform(regexp_extract_all(clean, {q(L.QUOTE)}), lambda x: length({strip('substr(x, 2, length(x) - 2)')}))")
SIM = f"""s0 AS (SELECT doc_id, unnest(sents) AS s FROM base), s1 AS (SELECT doc_id, regexp_replace(s, '^[，、；：]+|[，、；：]+$', '', 'g') AS s FROM s0),
s2 AS (SELECT doc_id, regexp_replace(s, {q(L.NOT_LIKE)}, '', 'g') AS s FROM s1 WHERE length(s) BETWEEN 8 AND 80), sm AS (SELECT doc_id, count(*) AS similes FROM s2 WHERE {O.SIMILE} GROUP BY doc_id)"""
PUNCT = list(L.PUNCTUATION)
DENSITIES = f"""WITH {DOCS}, {SIM}, m AS (SELECT doc_id, length(clean) AS total_chars, {', '.join(f"{count('clean', L.PUNCTUATION[k])} AS n_{k}" for k in PUNCT)}, {count('clean', L.SCENE_TIME)} + {count('clean', L.SCENE_MOVE)} AS cues, {QUOTED_CHARS} AS quoted, coalesce(similes, 0) AS similes FROM base LEFT JOIN sm USING (doc_id))
SELECT doc_id, {', '.join(f"{per(f'n_{k}')} AS {k}_density" for k in PUNCT)}, {per('n_exclamation + n_question')} AS excl_ques_density, {ratio('n_comma', 'n_period')} AS comma_per_period, {per('cues')} AS scene_density, {per('similes')} AS simile_density, {ratio('quoted', 'total_chars')} AS quoted_share FROM m"""


def share(a: str, cond: str) -> str:
    return f"len(list_filter({a}, lambda x: {cond})) * {D(100)} / CAST(greatest(len({a}), 1) AS DOUBLE)"


PAIRS = f"flatten(list_transform(regexp_extract_all(clean, {q(L.CJK + '{2,}')}), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"
MEASURES = f"""WITH {DOCS}, {SIM}, {O.MIX}, mm AS (SELECT doc_id, length(clean) AS total_chars, list_transform(sents, lambda s: length(s)) AS lens, paras, {count('clean', L.PUNCTUATION['exclamation'])} AS ne, {count('clean', L.PUNCTUATION['question'])} AS nq,
 {count('clean', L.PUNCTUATION['ellipsis'])} AS nl, {count('clean', L.PUNCTUATION['dash'])} AS nd, {QUOTED_CHARS} AS qc, {count('clean', L.QUOTE)} AS quotes, {PAIRS} AS words, {O.present(L.POSITIVE)} AS pos, {O.present(L.NEGATIVE)} AS neg FROM base),
me0 AS (SELECT doc_id, {share('lens', 'x <= 10')} AS short, {share('paras', 'x <= 8')} AS short_para, {ratio(total('lens'), 'len(lens)')} AS avg, {per('ne')} AS excl, {per('nq')} AS ques, {per('nl')} AS ell, {per('nd')} AS dash, {per('coalesce(similes, 0)')} AS simile,
 {ratio('qc', 'total_chars')} AS quoted, quotes, action, mind AS mental, scenery, action + mind + scenery AS dsc, CASE WHEN len(words) > 0 THEN len(list_distinct(words)) / CAST(len(words) AS DOUBLE) END AS ttr, pos, neg FROM mm LEFT JOIN sm USING (doc_id) JOIN mix USING (doc_id)),
me AS (SELECT *, CASE WHEN dsc > 0 THEN action * {D(100)} / CAST(dsc AS DOUBLE) END AS act, CASE WHEN dsc > 0 THEN mental * {D(100)} / CAST(dsc AS DOUBLE) END AS mind, CASE WHEN dsc > 0 THEN scenery * {D(100)} / CAST(dsc AS DOUBLE) END AS env,
 {ratio('action', 'mental')} AS act_per_mind, CASE WHEN pos + neg > 0 THEN (pos - neg) / CAST(pos + neg AS DOUBLE) ELSE {D(0)} END AS balance, quoted / greatest({D('0.000001')}, 1 - quoted) AS told FROM me0)"""
MARKERS = [("short_sentences", "short >= 30"), ("dialogue", f"quoted >= {D(0.3)}"), ("similes", "simile >= 2"), ("dashes", f"dash >= {D(1.5)}"), ("ellipses", f"ell >= {D(1.5)}"), ("long_sentences", "avg >= 28"), ("action", f"act_per_mind >= {D(2.5)}")]
SIGNALS = [("X1", "short > 30 AND excl > 5"), ("X2", "short > 30 AND excl < 2"), ("X3", "short_para > 20 AND quotes > 0"), ("X4", f"ttr > {D(0.5)} AND simile > 3"), ("X6", "mind > 30 AND excl < 3"), ("X7", "act > 50 AND short > 25"), ("X8", "env > 25 AND avg > 30")]
SCORES = [
    ("轻松搞笑型", "short > 35 AND excl > 5", f"short * {D(0.3)} + excl * 2"), ("冷静快节奏型", "short > 30 AND excl < 2", f"short * {D(0.3)} + (2 - excl) * 3"), ("推理驱动型", f"ques > 5 AND excl < ques * {D(0.5)}", f"ques * 2 + (ques - excl) * {D(0.5)}"),
    ("对话驱动型", f"short > 25 AND told > {D(0.8)}", f"short * {D(0.2)} + told * 10"), ("动作快节奏型", "act > 60 AND short > 20", f"act * {D(0.3)} + short * {D(0.2)}"), ("内省克制型", "mind > 35 AND excl < 3", f"mind * {D(0.3)} + (3 - excl) * 2"),
    ("铺陈留白型", "avg > 35 AND ell > 2", f"avg * {D(0.2)} + ell * 2"), ("热血爆发型", "excl > 8 AND short > 25", f"excl * 2 + short * {D(0.2)}"), ("暗黑深沉型", f"balance < {D(-0.3)} AND mind > 25", f"abs(balance) * 10 + mind * {D(0.2)}"),
    ("极简利落型", "avg < 20 AND short > 35", f"(20 - avg) * {D(0.5)} + short * {D(0.3)}"), ("克制写实型", f"ell < {D(0.3)} AND excl < 2", f"({D(0.3)} - ell) * 10 + (2 - excl) * 2"), ("热血爽文型", f"excl > 5 AND balance > {D(0.2)}", f"excl * {D(1.5)} + balance * 10"),
    ("悬疑动作型", "ques > 3 AND act > 50", f"ques * 2 + act * {D(0.1)}"),
]
LABELLED = f"""{MEASURES}, lb AS ({' UNION ALL '.join(f"SELECT doc_id, {q(n)} AS label, {s} AS score FROM me WHERE {g}" for n, g, s in SCORES)}), ok AS (SELECT * FROM lb WHERE score > 0),
al AS (SELECT * FROM ok UNION ALL SELECT doc_id, CASE WHEN short > 25 THEN '快节奏叙事型' WHEN avg > 30 THEN '沉稳铺陈型' ELSE '均衡叙事型' END, {D(0)} FROM me WHERE doc_id NOT IN (SELECT doc_id FROM ok))
SELECT doc_id, rank, label, score FROM (SELECT *, {rank('doc_id', 'score DESC, encode(label)')} FROM al) WHERE rank <= 5"""
TAILS = f"list_transform(list_filter(regexp_extract_all(clean, {q(L.CJK + '{2,}')}), lambda r: length(r) % 2 = 1), lambda r: right(r, 1))"


def of_length(cond: str) -> str:
    return ratio(f"len(list_filter(words, lambda w: {cond}))", "len(words)")


LOW = f"""WITH {DOCS}, w AS (SELECT doc_id, length(clean) AS total_chars, {PAIRS} AS pairs, {TAILS} AS tails, {O.parts('clean', L.LOW_SENTENCE)} AS s FROM base),
x AS (SELECT doc_id, total_chars, pairs, list_concat(pairs, tails) AS words, len(s) AS n, {total(O.CLAUSES)} AS clauses, {total(f"list_transform(s, lambda x: {count('x', L.SUBORDINATE)})")} AS sb, {total(f"list_transform(s, lambda x: {count('x', L.COORDINATE)})")} AS co FROM w),
y AS (SELECT *, len(list_filter(words, lambda w: length(w) >= 4)) AS complex_words, {of_length('length(w) >= 4')} AS complex_ratio, {ratio('clauses', 'n')} AS clauses_per_sentence FROM x)
SELECT doc_id, complex_words, complex_ratio, {D(1.043)} * sqrt(complex_words / CAST(greatest(n, 1) AS DOUBLE)) + {D(3.1291)} AS smog_index, {D(0.4)} * ({ratio('total_chars', 'n')} + 100 * complex_ratio) AS yang_index, {D(0.4)} * ({ratio('len(words)', 'n')} + 100 * complex_ratio) AS fog_index,
 {ratio('len(list_distinct(words))', 'len(words)')} AS ttr, {ratio('len(list_distinct(pairs))', 'len(pairs)')} AS ttr_filtered, clauses_per_sentence, {ratio('sb', 'clauses')} AS subordinate_ratio, {ratio('co', 'clauses')} AS coordinate_ratio,
 CASE WHEN n = 0 THEN 'none' WHEN clauses_per_sentence < 1.5 THEN 'simple' WHEN clauses_per_sentence < 2.5 THEN 'light' WHEN clauses_per_sentence < 3.5 THEN 'compound' ELSE 'complex' END AS clause_level,
 {of_length('length(w) = 1')} AS len_1, {of_length('length(w) = 2')} AS len_2, {of_length('length(w) = 3')} AS len_3, {of_length('length(w) >= 4')} AS len_4plus FROM y"""
TOK = f"tk AS (SELECT doc_id, len(regexp_extract_all(clean, {q(L.CJK + '{2,}')})) AS r, len(regexp_extract_all(clean, {q(L.CJK)})) AS c FROM base)"
RATIOS = {
    "style_densities": DENSITIES,
    "style_markers": f"{MEASURES} SELECT doc_id, CASE WHEN len(h) > 0 THEN array_to_string(h[1:5], ',') ELSE 'ordinary' END AS markers FROM (SELECT doc_id, list_filter([{', '.join(f'CASE WHEN {p} THEN {q(n)} END' for n, p in MARKERS)}], lambda x: x IS NOT NULL) AS h FROM me)",
    "style_signals": f"{MEASURES} {' UNION ALL '.join(f'SELECT doc_id, {q(n)} AS signal FROM me WHERE {p}' for n, p in SIGNALS)}",
    "scored_labels": LABELLED,
    "deployment": f"{MEASURES} SELECT doc_id, CASE WHEN told > {D(1.2)} OR quotes > 3000 THEN 8192 WHEN told > {D(0.8)} OR quotes > 1000 THEN 6144 ELSE 4096 END AS max_tokens FROM me",
    "low_level_ratios": LOW,
    "special_systems": f"WITH {DOCS} " + " UNION ALL ".join(f"SELECT doc_id, {q(w)} AS word FROM base WHERE contains(clean, {q(w)})" for w in L.SYSTEM_WORDS),
    "tagged_tokens": f"""WITH {DOCS}, t AS (SELECT doc_id, list_concat(list_transform(regexp_extract_all(clean, {q(L.CJK + '{2,}')}), lambda r: {{'word': r, 'flag': 'n'}}), list_transform(regexp_extract_all(clean, {q(L.CJK)}), lambda r: {{'word': r, 'flag': ''}})) AS l FROM base)
SELECT doc_id, CAST(i AS INTEGER) AS pos, l[i].word AS word, l[i].flag AS flag FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t)""",
    "pos_shares": f"WITH {DOCS}, {TOK} SELECT doc_id, {ratio('r', 'r')} AS noun_ratio, {D(0)} AS verb_ratio, {D(0)} AS adjective_ratio, {D(0)} AS adverb_ratio, {ratio('r', 'r + c')} AS content_ratio, r AS content_words FROM tk WHERE c > 0",
    "entities": f"WITH {DOCS}, {TOK} SELECT doc_id, 0 AS person, 0 AS place, 0 AS org, 0 AS other, 0 AS entities, {D(0)} AS density FROM tk WHERE c > 0",
}

LAST = "li AS (SELECT DISTINCT ON (item_id) * FROM evidence_item ORDER BY item_id, ingested_at DESC)"
VERIFIED = O.VERIFY.replace("SELECT item_id, coalesce(status", "vr AS (SELECT item_id, coalesce(status", 1).replace("\nvr AS", ",\nvr AS") + ")"
CONF = f"coalesce(lower({strip('confidence')}), 'high')"


def low(x: str) -> str:
    return f"CASE WHEN {x} = 'high' THEN 'mid' ELSE 'low' END"


POOL_CTE = O.POOL[: O.POOL.rindex(" SELECT work_id, printf")] + ", pool AS (SELECT work_id, printf('E%04d', rank) AS evidence_id, chunk_id, era, type, s AS quote FROM b WHERE rank <= 28)"
SPANS = "sp AS (SELECT work_id, era, min(start_pos) AS st, max(start_pos + length(chunk_text)) AS en FROM evidence_store WHERE era_id IS NOT NULL GROUP BY ALL)"
PROMISE = {k: (f"contains(body, {q(t)})", f"contains(coalesce(quote, ''), {q(m)})") for k, (t, m) in L.PROMISED_MARKS.items()}
PROMISE["speech"] = (f"regexp_matches(body, {q('|'.join(L.SPEECH_TERMS))})", f"regexp_matches(coalesce(quote, ''), {q(L.SPEECH_SHOWN)})")
PROMISE["comparison"] = (f"regexp_matches(body, {q('|'.join(L.COMPARISON_TERMS))})", f"regexp_matches(coalesce(quote, ''), {q(L.COMPARISON_SHOWN)})")


def blank(c: str) -> str:
    return f"coalesce({strip(c)}, '') = ''"


def listing(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(k)} END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


LEVEL = "NOT coalesce(lower({}) IN ('high', 'mid', 'low'), false)"
SCHEMA = {
    "name": f"{blank('card_name')} OR list_contains({O.listed(L.STOCK_NAMES)}, {strip('card_name')})", "definition": blank("definition"), "trigger": f"{blank('trigger_cond')} OR list_contains({O.listed(L.STOCK_TRIGGERS)}, {strip('trigger_cond')})",
    "steps": "coalesce(len(steps), 0) NOT BETWEEN 3 AND 5", "boundary": blank("boundary"), "evidence": "n < 2", "quote": "n >= 2 AND nq > 0", "metric": "n >= 2 AND nm > 0", "counterexample": blank("counterexample"), "purpose": blank("serves_purpose"),
    "transferability": LEVEL.format(strip("transferability")), "confidence": LEVEL.format(strip("confidence")),
}
CARDS = {
    "evidence_positions": f"{POOL_CTE} SELECT work_id, evidence_id, chunk_id, pool.era, start_pos + instr(chunk_text, quote) - 1 AS start_pos, start_pos + instr(chunk_text, quote) - 1 + length(quote) AS end_pos FROM pool JOIN once USING (work_id, chunk_id)",
    "quote_eras": f"""WITH {O.ONCE}, {LAST}, {SPANS}, m AS (SELECT item_id, li.work_id, o.era AS label, CASE WHEN length(quote) > 0 AND instr(chunk_text, quote) > 0 THEN start_pos + instr(chunk_text, quote) - 1 END AS pos FROM li JOIN once o ON o.work_id = li.work_id AND o.chunk_id = lower(trim(li.chunk_id)) WHERE trim(li.chunk_id) <> ''),
f AS (SELECT item_id, label, sp.era, row_number() OVER (PARTITION BY item_id ORDER BY st, encode(sp.era)) AS r FROM m LEFT JOIN sp ON sp.work_id = m.work_id AND pos >= st AND pos < en) SELECT item_id, coalesce(era, label) AS era FROM f WHERE r = 1""",
    "verified_cards": f"""{VERIFIED}, {LAST}, n AS (SELECT card_id, count(*) FILTER (WHERE status = 'valid') AS valid, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'downgraded') AS downgraded FROM li JOIN vr USING (item_id) GROUP BY 1)
SELECT c.card_id, coalesce(valid, 0) AS valid, coalesce(fixed, 0) AS fixed, coalesce(downgraded, 0) AS downgraded, CASE WHEN downgraded > 0 THEN {low(CONF)} ELSE {CONF} END AS confidence FROM technique_card c LEFT JOIN n USING (card_id)""",
    "references": f"{POOL_CTE}, {LAST} SELECT item_id, p.era IS NOT NULL AS known, p.era FROM li LEFT JOIN pool p ON p.work_id = li.work_id AND p.evidence_id = {strip('li.evidence_id')} WHERE {strip('li.evidence_id')} <> ''",
    "expanded": f"""{POOL_CTE}, {LAST}, h AS (SELECT DISTINCT card_id, {strip('evidence_id')} AS evidence_id FROM li WHERE evidence_id IS NOT NULL), r AS (SELECT card_id, printf('E%04d', n) AS evidence_id FROM technique_card, (VALUES (1), (2), (3)) v(n))
SELECT r.card_id, r.evidence_id, p.chunk_id, p.quote, p.era FROM r ANTI JOIN h USING (card_id, evidence_id) JOIN technique_card c ON c.card_id = r.card_id JOIN pool p ON p.work_id = c.work_id AND p.evidence_id = r.evidence_id""",
    "reinforced": f"""WITH {LAST}, s AS (SELECT card_id, {', '.join(f'bool_or({m}) AS {k}' for k, (_, m) in PROMISE.items())} FROM li GROUP BY 1), c AS (SELECT card_id, coalesce(card_name, '') || ' ' || coalesce(definition, '') AS body, {CONF} AS c FROM technique_card),
p AS (SELECT card_id, {listing({k: f'{t} AND NOT {k}' for k, (t, _) in PROMISE.items()})} AS problems, c FROM c JOIN s USING (card_id)) SELECT card_id, problems, {low('c')} AS confidence FROM p WHERE problems <> ''""",
    "era_excerpts": f"WITH {O.ONCE}, m AS (SELECT *, row_number() OVER (PARTITION BY work_id, era ORDER BY chunk_id) AS i, count(*) OVER (PARTITION BY work_id, era) AS n FROM once) SELECT work_id, era, chunk_id, substr({strip('chunk_text')}, 1, 900) AS excerpt FROM m WHERE i = n // 2 + 1",
    "copy_references": f"""WITH RECURSIVE {O.ONCE}, g AS (SELECT work_id, era, list(chunk_id ORDER BY chunk_id) AS l, min(chunk_id) AS first FROM once GROUP BY ALL),
w AS (SELECT work_id, era, first, l, 0 AS round, l[len(l) // 2 + 1] AS chunk_id FROM g UNION ALL SELECT work_id, era, first, z, round + 1, z[len(z) // 2 + 1] FROM (SELECT *, list_concat(l[1:len(l) // 2], l[len(l) // 2 + 2:]) AS z FROM w) x WHERE len(z) > 0 AND round < 9),
k AS (SELECT *, {rank('work_id', 'round, first')} FROM w) SELECT work_id, rank, chunk_id, era FROM k WHERE rank <= 10""",
    "card_schema": f"WITH {LAST}, n AS (SELECT card_id, count(*) AS n, count(*) FILTER (WHERE {blank('quote')}) AS nq, count(*) FILTER (WHERE {blank('metric')}) AS nm FROM li GROUP BY 1), b AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(nq, 0) AS nq, coalesce(nm, 0) AS nm FROM technique_card c LEFT JOIN n USING (card_id)), p AS (SELECT card_id, {listing(SCHEMA)} AS problems FROM b) SELECT * FROM p WHERE problems <> ''",
}

MARK = q(L.SCENE_MARK)


def scenes(table: str) -> str:
    return f"""sc0 AS (SELECT doc_id, string_split_regex(coalesce(text, ''), {MARK}) AS p, regexp_extract_all(coalesce(text, ''), {MARK}) AS m FROM {table}), sc1 AS (SELECT doc_id, p, m, unnest(range(1, len(p) + 1)) AS i FROM sc0),
sc2 AS (SELECT doc_id, i, {strip(f"(CASE WHEN i > 1 AND starts_with({strip('m[i - 1]')}, '#') THEN {strip('m[i - 1]')} || chr(10) ELSE '' END || p[i])")} AS text FROM sc1),
sc AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS scene, text FROM sc2 WHERE text <> '')"""


TYPE = "CASE " + " ".join(f"WHEN regexp_matches(left(text, 40), {q('|'.join(w))}) THEN {q(n)}" for n, w in L.SCENE_TYPES) + " END"
TYPE_NAMES = O.listed([n for n, _ in L.SCENE_TYPES])


def checks(table: str) -> str:
    return f"""{scenes(table)}, sk AS (SELECT doc_id, count(*) AS n_scenes, count(*) FILTER (WHERE length(text) < 800) AS short_scenes, list({TYPE}) FILTER (WHERE {TYPE} IS NOT NULL) AS types FROM sc GROUP BY 1),
sl AS (SELECT d.doc_id, coalesce(n_scenes, 0) AS n_scenes, coalesce(short_scenes, 0) AS short_scenes, CASE WHEN len(types) > 0 THEN array_to_string(list_filter({TYPE_NAMES}, lambda x: NOT list_contains(types, x)), ',') END AS missing_types FROM {table} d LEFT JOIN sk USING (doc_id)),
chk AS (SELECT *, n_scenes BETWEEN 2 AND 3 AND short_scenes = 0 AND coalesce(missing_types, '') = '' AS meets FROM sl)"""


SCENE_BASE = O.lines_cte("doc_id, scene", "sc")
LENS = "list_transform(sents, lambda s: length(s))"
ERA_CHUNKS = O.lines_cte("work_id, chunk_id, era", "once", "chunk_text")


def similes(keys: str) -> str:
    return f"""s0 AS (SELECT {keys}, unnest(sents) AS s FROM base), s1 AS (SELECT {keys}, regexp_replace(s, '^[，、；：]+|[，、；：]+$', '', 'g') AS s FROM s0),
s2 AS (SELECT {keys}, regexp_replace(s, {q(L.NOT_LIKE)}, '', 'g') AS s FROM s1 WHERE length(s) BETWEEN 8 AND 80), sm AS (SELECT {keys}, count(*) AS similes FROM s2 WHERE {O.SIMILE} GROUP BY ALL)"""


CHUNK_SUMS = f"""{O.ONCE}, {ERA_CHUNKS}, {similes('work_id, chunk_id')}, cs AS (SELECT base.work_id, base.chunk_id, base.era, clean, length(clean) AS total_chars, len(sents) AS n_sentences, {total(LENS)} AS sentence_chars, len(list_filter({LENS}, lambda x: x <= 10)) AS short_sentences,
 len(list_filter({LENS}, lambda x: x >= 50)) AS long_sentences, len(paras) AS n_paragraphs, {total('paras')} AS paragraph_chars, {QUOTED_CHARS} AS quoted, coalesce(similes, 0) AS similes FROM base LEFT JOIN sm ON sm.work_id = base.work_id AND sm.chunk_id = base.chunk_id)"""
SUMMED = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total_chars", "n_sentences", "sentence_chars", "short_sentences", "long_sentences", "n_paragraphs", "paragraph_chars", "quoted", "similes"))
VALUES = f"""{ratio('sentence_chars', 'n_sentences')} AS avg_sentence, {ratio('short_sentences', 'n_sentences')} AS short_share, {ratio('long_sentences', 'n_sentences')} AS long_share, {ratio('paragraph_chars', 'n_paragraphs')} AS avg_paragraph,
 {ratio('quoted', 'total_chars')} AS quoted_share, similes * {D(1000)} / CAST(greatest(total_chars, 1) AS DOUBLE) AS simile_density"""
ERAS = O.listed(L.ERAS)
WINDOWS = f"{CHUNK_SUMS}, ew AS (SELECT work_id, era, {SUMMED} FROM cs WHERE list_contains({ERAS}, era) GROUP BY ALL HAVING sum(total_chars) >= 200)"
TREND = f"CASE WHEN n < 2 THEN 'too_few' WHEN span = 0 THEN 'steady' WHEN mean = 0 THEN 'shifting' WHEN span / abs(mean) <= {D('0.10')} THEN 'steady' WHEN abs(net) / path >= 0.5 THEN CASE WHEN net > 0 THEN 'rising' ELSE 'falling' END ELSE 'shifting' END"
SIX = ["avg_sentence", "short_share", "long_share", "avg_paragraph", "quoted_share", "vocabulary"]
MATRIX = f"""WITH {WINDOWS}, ru AS (SELECT work_id, era, unnest(regexp_extract_all(clean, {q(L.CJK + '{2,}')})) AS r FROM cs WHERE list_contains({ERAS}, era)), wd AS (SELECT work_id, era, substr(r, i, 2) AS word FROM (SELECT *, unnest(range(1, length(r))) AS i FROM ru)),
wn AS (SELECT work_id, era, count(DISTINCT word) AS u, count(*) AS n FROM wd GROUP BY ALL), v AS (SELECT ew.work_id, list_position({ERAS}, ew.era) AS p, {VALUES}, {ratio('u', 'n')} AS vocabulary FROM ew LEFT JOIN wn ON wn.work_id = ew.work_id AND wn.era = ew.era),
m AS ({' UNION ALL '.join(f"SELECT work_id, p, '{k}' AS measure, {k} AS v FROM v" for k in SIX)}), sq AS (SELECT work_id, measure, list(v ORDER BY p) AS v FROM m WHERE v IS NOT NULL GROUP BY ALL),
t AS (SELECT *, len(v) AS n, list_sum(v) / len(v) AS mean, list_max(v) - list_min(v) AS span, v[len(v)] - v[1] AS net, list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))) AS path FROM sq)
SELECT work_id, measure, CAST(n AS INTEGER) AS eras, mean, {TREND} AS trend FROM t"""
FOUR = ["avg_sentence", "short_share", "quoted_share", "simile_density"]
BANDED = f"""ev AS (SELECT work_id, {VALUES} FROM ew), em AS ({' UNION ALL '.join(f"SELECT work_id, '{k}' AS measure, {k} AS v FROM ev" for k in FOUR)}), e1 AS (SELECT work_id, measure, median(v) AS med, list(v) AS l FROM em GROUP BY ALL HAVING count(*) >= 4),
e2 AS (SELECT work_id, measure, med, list_median(list_transform(l, lambda x: abs(x - med))) AS mad FROM e1), e3 AS (SELECT *, CASE WHEN mad <> 0 THEN mad WHEN med <> 0 THEN abs(med) * {D(0.05)} ELSE 0.5 END AS w FROM e2),
bands AS (SELECT work_id, measure, med AS median, greatest({D(0)}, med - 3 * w) AS low, med + 3 * w AS high FROM e3)"""
TRIALS = f"""tt AS (SELECT lower({strip('title')}) AS t, min(work_id) AS work_id FROM works WHERE {strip('title')} <> '' GROUP BY 1), tr AS (SELECT doc_id, tt.work_id, coalesce(text, '') AS text FROM documents JOIN tt ON tt.t = lower({strip('work_title')}) WHERE doc_kind = 'trial')"""


def renamed(cte: str, names: list[str], mark: str) -> str:
    """The CTE with its names marked, so that it can stand beside another copy."""
    import re

    for n in names:
        cte = re.sub(rf"(?<![\w'.]){n}(?![\w'])", n + mark, cte)
    return cte


TRIAL_BASE = renamed(O.lines_cte("doc_id, work_id", "tr"), ["src", "ln0", "ln1", "ln", "agg", "base"], "_t")
TRIAL_SIM = renamed(similes("doc_id"), ["base", "s0", "s1", "s2", "sm"], "_t")
TRIAL_VALUES = f"""{TRIALS}, {TRIAL_BASE}, {TRIAL_SIM}, tv AS (SELECT b.doc_id, work_id, {ratio(total(LENS), 'len(sents)')} AS avg_sentence, len(list_filter({LENS}, lambda x: x <= 10)) * {D(100)} / CAST(greatest(len(sents), 1) AS DOUBLE) / {D(100)} AS short_share,
 {ratio(QUOTED_CHARS, 'length(clean)')} AS quoted_share, coalesce(similes, 0) * {D(1000)} / CAST(greatest(length(clean), 1) AS DOUBLE) AS simile_density FROM base_t b LEFT JOIN sm_t ON sm_t.doc_id = b.doc_id)"""
LIMIT = f"CASE measure WHEN 'avg_sentence' THEN {D(0.15)} WHEN 'simile_density' THEN {D('0.30')} ELSE {D('0.10')} END"
RELATIVE = "measure IN ('avg_sentence', 'simile_density')"
DEVIATION = f"""{WINDOWS}, {BANDED}, {TRIAL_VALUES}, ws AS (SELECT work_id, {SUMMED} FROM cs GROUP BY 1), wv AS (SELECT work_id, {VALUES} FROM ws), rf AS ({' UNION ALL '.join(f"SELECT work_id, '{k}' AS measure, {k} AS reference FROM wv" for k in FOUR)}),
tm AS ({' UNION ALL '.join(f"SELECT doc_id, work_id, '{k}' AS measure, {k} AS trial FROM tv" for k in FOUR)}), dv AS (SELECT doc_id, measure, reference, trial, CASE WHEN {RELATIVE} THEN abs(trial - reference) / reference ELSE abs(trial - reference) END AS deviation, coalesce(trial BETWEEN low AND high, false) AS inside
 FROM tm JOIN rf USING (work_id, measure) LEFT JOIN bands USING (work_id, measure) WHERE NOT ({RELATIVE}) OR reference > 0), dev AS (SELECT doc_id, measure, reference, trial, deviation, CASE WHEN inside THEN 'author_band' ELSE 'fixed_tolerance' END AS basis, inside OR deviation <= {LIMIT} AS passed FROM dv)"""
PROFILE = "CASE " + " ".join(f"WHEN regexp_matches(body, {q('|'.join(t))}) THEN {q(n)}" for n, t, _ in L.CARD_PROFILES) + " END"
SHOWN = "CASE profile " + " ".join(f"WHEN {q(n)} THEN {' OR '.join(f'contains(text, {q(m)})' for m in marks)}" for n, _, marks in L.CARD_PROFILES if marks) + " END"
WORK_QUOTES = renamed(QUOTED.replace(DOCS, O.lines_cte("work_id, chunk_id", "once", "chunk_text")).replace("doc_id", "work_id, chunk_id"), ["src", "ln0", "ln1", "ln", "agg", "base", "q0", "q1", "q2", "qs", "qq", *[f"{s}{i}" for s in ("lft", "rgt") for i in (0, 1, 2, 6, 9)]], "_w")
LINES_OF = f"list_filter(list_transform(regexp_extract_all(text, {q(L.LINE)}), lambda x: length({strip('x')})), lambda n: n > 0)"
MOST = "greatest(3, length(text) // 350)"
USE = f"""{WORK_QUOTES}, tg AS (SELECT work_id, tag, count(*) AS n FROM qq_w WHERE tag IS NOT NULL GROUP BY ALL), tp AS (SELECT work_id, tag AS top_tag FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, encode(tag)) AS r FROM tg) WHERE r = 1),
cp AS (SELECT card_id, work_id, {PROFILE} AS profile FROM (SELECT card_id, work_id, concat_ws(' ', coalesce(card_name, ''), coalesce(definition, ''), array_to_string(steps, ' ')) AS body FROM technique_card)),
cu AS (SELECT doc_id, card_id, profile, CASE WHEN profile IS NULL THEN 'not_applicable' WHEN profile = 'rhythm' THEN CASE WHEN len(list_filter({LINES_OF}, lambda n: n <= 8)) > 0 OR len({LINES_OF}) >= 3 THEN 'covered' ELSE 'uncovered' END WHEN NOT ({SHOWN}) THEN 'uncovered'
 WHEN (profile = 'ellipsis' AND {words('text', ['……'])} > {MOST}) OR (profile = 'dash' AND {words('text', ['——'])} > {MOST}) THEN 'deformed' WHEN profile = 'dialogue_tag' AND NOT coalesce(contains(text, top_tag), true) THEN 'uncovered' ELSE 'covered' END AS status
 FROM tr JOIN cp USING (work_id) LEFT JOIN tp USING (work_id))"""
FIDELITY = {
    "scene_texts": f"WITH {scenes('documents')} SELECT * FROM sc",
    "scene_checks": f"WITH {checks('documents')} SELECT * FROM chk",
    "scene_measures": f"WITH {scenes('documents')}, {SCENE_BASE} SELECT b.doc_id, b.scene, length(sc.text) AS chars, {ratio(total(LENS), 'len(sents)')} AS avg_sentence, {ratio(QUOTED_CHARS, 'length(clean)')} AS quoted_share FROM base b JOIN sc ON sc.doc_id = b.doc_id AND sc.scene = b.scene",
    "era_windows": f"WITH {WINDOWS} SELECT * FROM ew",
    "era_matrix": MATRIX,
    "window_bands": f"WITH {WINDOWS}, {BANDED} SELECT * FROM bands",
    "deviations": f"WITH {DEVIATION} SELECT * FROM dev",
    "card_use": f"WITH {O.ONCE}, {TRIALS}, {USE} SELECT * FROM cu",
    "verdicts": f"""WITH {DEVIATION}, {USE}, {checks('tr')}, cy AS ({O.COPY.replace('WITH trial', 'WITH trial_c').replace('FROM trial', 'FROM trial_c')}), md AS (SELECT doc_id, bool_and(passed) AS m FROM dev GROUP BY 1), ub AS (SELECT doc_id, count(*) FILTER (WHERE status IN ('uncovered', 'deformed')) AS b, count(*) FILTER (WHERE status <> 'not_applicable') AS a FROM cu GROUP BY 1),
o AS (SELECT tr.doc_id, coalesce(m, true) AS measures_passed, coalesce(b, 0) AS blocking_cards, coalesce(a, 0) AS applicable_cards, coalesce(NOT at_risk, true) AS copies_passed, meets AS scenes_passed FROM tr JOIN chk ON chk.doc_id = tr.doc_id LEFT JOIN md ON md.doc_id = tr.doc_id LEFT JOIN ub ON ub.doc_id = tr.doc_id LEFT JOIN cy ON cy.doc_id = tr.doc_id)
SELECT *, measures_passed AND blocking_cards = 0 AND copies_passed AND scenes_passed AS passed FROM o""",
}

WORD = "^[\\x00-\\x7f]+$"


def term_hits(text: str, term: str) -> str:
    """Occurrences of a term, whole words only for ASCII terms: the other engine has no look-around, so neighbours are tested by splitting at the term."""
    word = f"len(list_filter(range(1, len(string_split({text}, {term}))), lambda i: NOT regexp_matches(string_split({text}, {term})[i], '[A-Za-z0-9_]$') AND NOT regexp_matches(string_split({text}, {term})[i + 1], '^[A-Za-z0-9_]')))"
    return f"CASE WHEN NOT contains({text}, {term}) THEN 0 WHEN regexp_matches({term}, '{WORD}') THEN {word} ELSE (length({text}) - length(replace({text}, {term}, ''))) // length({term}) END"


WORK_SAID = f"""{WORK_QUOTES}, v0 AS (SELECT work_id, regexp_replace(name, {q(f'^[{O.PUNCT}]+|[{O.PUNCT}]+$')}, '', 'g') AS v0 FROM qq_w WHERE name IS NOT NULL),
{', '.join(f"v{i + 1} AS (SELECT * EXCLUDE (v{i}), CASE WHEN length(v{i}) > 2 THEN {O.VERB.format(f'v{i}')} ELSE v{i} END AS v{i + 1} FROM v{i})" for i in range(4))},
ws AS (SELECT work_id, v4 AS speaker FROM v4 WHERE v4 <> '' AND NOT list_contains({O.listed(['她', '他', '它', '她俩', '他俩', *L.NO_NAMES])}, v4) AND NOT (length(v4) = 2 AND regexp_matches(v4, '^[她他它]')) AND NOT regexp_matches(v4, '[的了吗呢吧啊呀哦嘛]') AND regexp_matches(v4, '^[\\x{{4e00}}-\\x{{9fa5}}A-Za-z·]{{2,6}}$'))"""
TOPPED = "(SELECT work_id, term, n FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY n DESC, encode(term)) AS r FROM {}) WHERE r <= {})"
CANDIDATES = f"""{O.ONCE}, {O.TERMS}, {WORK_SAID}, sn AS (SELECT work_id, speaker AS term, count(*) AS n FROM ws GROUP BY ALL), br AS (SELECT work_id, unnest(regexp_extract_all(chunk_text, {q(L.BRACKETED)}, 1)) AS term FROM once), bn AS (SELECT work_id, term, count(*) AS n FROM br WHERE NOT list_contains({O.listed(L.NO_IDENTITY)}, term) GROUP BY ALL),
cand AS (SELECT work_id, kind, term, CASE kind WHEN 'author' THEN 1000 ELSE 999 END AS score FROM tm WHERE length(term) >= 2 UNION ALL SELECT work_id, 'character', term, n * 5 FROM {TOPPED.format('sn', 3)} WHERE n >= 2 UNION ALL SELECT work_id, 'world', term, n * 10 FROM {TOPPED.format('bn', 5)})"""
FLAT = "regexp_replace(coalesce({0}, ''), '[\\r\\n]+', ' ', 'g')"
MASKED_LINES = f"""WITH li AS (SELECT item_id, arg_max({{'quote': quote, 'metric': metric, 'note': note}}, ingested_at) AS x FROM evidence_item GROUP BY 1), h AS (SELECT item_id, '[I' || item_id || '] “' || {FLAT.format('x.quote')} || '” (' || {FLAT.format('x.metric')} || ') — 注解：' || {FLAT.format('x.note')} AS line FROM li),
c AS (SELECT item_id, line, regexp_extract(line, '(?s)^(.*?)(?:—[{L.WS}]*注解：|注解：)', 1) AS head FROM h)
SELECT item_id, regexp_replace(head, '^(\\[[a-zA-Z0-9_-]+\\][{L.WS}]*[“"''「『])(.*)([”"''」』])', '\\1某\\3') || substr(line, length(head) + 1) AS line FROM c"""
MAPPED = f"""{CANDIDATES}, mp AS (SELECT work_id, {strip("coalesce(original, '')")} AS o, {strip("coalesce(replacement, '')")} AS r FROM (SELECT work_id, term AS original, CASE kind WHEN 'author' THEN '某作者' WHEN 'title' THEN '某' || term WHEN 'character' THEN '某人' ELSE term END AS replacement FROM cand UNION ALL SELECT work_id, '未列之名', '' FROM works UNION ALL SELECT work_id, ' ', '某物' FROM works)),
kt AS (SELECT DISTINCT work_id, {strip('term')} AS term FROM cand WHERE term <> ''), ot AS (SELECT * FROM kt WHERE length(term) >= 2 UNION SELECT work_id, o FROM mp WHERE o <> '' AND length(o) >= 2)"""
IDENTITY = {
    "candidates": f"WITH {CANDIDATES} SELECT * FROM cand",
    "masked_evidence": MASKED_LINES,
    "mapping_problems": f"""WITH {MAPPED} SELECT DISTINCT * FROM (SELECT work_id, o AS original, 'empty_key' AS problem FROM mp WHERE o = '' UNION ALL SELECT work_id, o, 'empty_value' FROM mp WHERE o <> '' AND r = '' UNION ALL SELECT work_id, o, 'identity' FROM mp WHERE o <> '' AND r = o
 UNION ALL SELECT work_id, o, 'label_length' FROM mp WHERE o <> '' AND r <> '' AND length(r) NOT BETWEEN 2 AND 4 UNION ALL SELECT work_id, o, 'unknown' FROM mp ANTI JOIN kt ON kt.work_id = mp.work_id AND kt.term = mp.o WHERE o <> '' UNION ALL SELECT mp.work_id, o, 'leak' FROM mp JOIN ot ON ot.work_id = mp.work_id AND contains(r, term) AND term <> o WHERE o <> '' AND r <> '')""",
    "card_leaks": f"""WITH {CANDIDATES}, fl AS ({' UNION ALL '.join(f"SELECT card_id, work_id, '.{c}' AS path, {c} AS value FROM technique_card" for c in ('card_name', 'definition', 'serves_purpose', 'trigger_cond', 'boundary', 'counterexample'))} UNION ALL SELECT card_id, work_id, '.steps[' || (i - 1) || ']', steps[i] FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS i FROM technique_card)),
ow AS (SELECT DISTINCT work_id, term FROM cand WHERE length(term) >= 2), z AS (SELECT card_id, path, term, CAST({term_hits('value', 'term')} AS BIGINT) AS hits FROM fl JOIN ow USING (work_id)) SELECT * FROM z WHERE hits > 0""",
    "body_leaks": f"""WITH {CANDIDATES}, tt AS (SELECT lower({strip('title')}) AS t, min(work_id) AS work_id FROM works WHERE {strip('title')} <> '' GROUP BY 1), kn AS (SELECT work_id, term, min(kind) AS kind FROM cand GROUP BY ALL),
z AS (SELECT doc_id, kind, term, CAST({term_hits('text', 'term')} AS BIGINT) AS hits FROM documents JOIN tt ON tt.t = lower({strip('work_title')}) JOIN kn ON kn.work_id = tt.work_id) SELECT * FROM z WHERE hits > 0""",
    "leak_scan": f"WITH {O.ONCE}, {O.TERMS}, z AS (SELECT work_id, chunk_id, kind, CAST({term_hits('chunk_text', 'term')} AS BIGINT) AS hits FROM once JOIN tm USING (work_id) WHERE length(term) >= 2) SELECT * FROM z WHERE hits > 0",
}
PLAN_CTE = O.READING_PLAN.replace("SELECT work_id, idx AS chapter_idx", "pl AS (SELECT work_id, idx AS chapter_idx", 1).replace("\npl AS", ",\npl AS") + ")"
OFFSETS = f"""{PLAN_CTE}, po AS (SELECT pl.work_id, pl.chapter_id, pl.chapter_idx, pl.era, chapter_no, title, coalesce(volume, '') AS volume, start_pos AS orig_start, end_pos AS orig_end FROM pl JOIN chapters c ON c.work_id = pl.work_id AND c.chapter_idx = pl.chapter_idx),
pf AS (SELECT *, coalesce(sum(orig_end - orig_start + 2) OVER (PARTITION BY work_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp FROM po)"""
ONE = "CASE WHEN {0}.v <> '' THEN {0}.v || '·' ELSE '' END || '第' || {0}.n || '章'"
VOLUMES = f"""{O.CHAPTER_INDEX.replace("SELECT work_id, CAST(idx AS INTEGER) AS chapter_idx, title", "ci AS (SELECT work_id, CAST(idx AS INTEGER) AS chapter_idx, title").replace(chr(10) + "ci AS", "," + chr(10) + "ci AS")}),
vh AS (SELECT DISTINCT work_id, start_pos + {total('list_transform(l[1:i - 1], lambda x: length(x))')} AS pos, regexp_extract({strip('l[i]')}, {q(f'^第[{L.NUMERALS}]+卷')}) AS volume FROM l1 WHERE regexp_matches({strip('l[i]')}, {q(L.VOLUME)}))
SELECT ci.work_id, chapter_idx, arg_max(volume, pos) AS volume FROM ci LEFT JOIN vh ON vh.work_id = ci.work_id AND vh.pos < ci.start_pos GROUP BY ci.work_id, chapter_idx"""
CHUNK_DOCS = O.lines_cte("work_id, chunk_id", "once", "chunk_text")
STRUCTURE = {
    "chapter_volumes": VOLUMES,
    "fallback_index": "SELECT doc_id, CAST(k // 4000 AS INTEGER) AS chapter_idx, printf('分段_%03d', k // 4000 + 1) AS title, CAST(k AS INTEGER) AS start_pos, CAST(least(k + 4000, n) AS INTEGER) AS end_pos, true AS is_fallback FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 4000)) AS k FROM documents WHERE length(text) > 0)",
    "plan_coverage": "SELECT work_id, count(*) AS n, count(*) AS covered FROM chapters GROUP BY 1",
    "plan_offsets": f"{OFFSETS} SELECT work_id, chapter_id, orig_start, orig_end, CAST(sp AS BIGINT) AS start_pos, CAST(sp + orig_end - orig_start AS BIGINT) AS end_pos FROM pf",
    "plan_summary": f"{OFFSETS}, w AS (SELECT work_id, max(end_pos) AS chars FROM chapters GROUP BY 1), z AS (SELECT work_id, count(*) AS n_sampled, CAST(max(sp + orig_end - orig_start) AS BIGINT) AS sampled_chars FROM pf GROUP BY 1) SELECT work_id, n_sampled, sampled_chars, sampled_chars * {D(100)} / CAST(greatest(chars, 1) AS DOUBLE) AS coverage_pct FROM z JOIN w USING (work_id)",
    "plan_ranges": f"""{OFFSETS}, lb AS (SELECT work_id, era, chapter_idx, volume AS v, CASE WHEN regexp_matches(title, '[章回节]') AND regexp_extract(title, '[0-9零一二三四五六七八九十百千万〇两]+') <> '' THEN regexp_extract(title, '[0-9零一二三四五六七八九十百千万〇两]+') ELSE CAST(chapter_no AS VARCHAR) END AS n FROM po),
en AS (SELECT work_id, era, arg_min({{'v': v, 'n': n}}, chapter_idx) AS a, arg_max({{'v': v, 'n': n}}, chapter_idx) AS b FROM lb GROUP BY ALL)
SELECT work_id, era, CASE WHEN a.v = '' AND b.v = '' THEN '第' || a.n || '~' || b.n || '章' WHEN a.v = b.v THEN a.v || ' 第' || a.n || '~' || b.n || '章' ELSE {ONE.format('a')} || ' ~ ' || {ONE.format('b')} END AS range FROM en""",
    "sampled_texts": f"""{OFFSETS}, {O.ONCE}, pt AS (SELECT pf.work_id, chapter_id, sp, o.start_pos AS s, substr(chunk_text, CAST(greatest(orig_start - o.start_pos, 0) + 1 AS BIGINT), CAST(least(orig_end, o.start_pos + length(chunk_text)) - greatest(orig_start, o.start_pos) AS BIGINT)) AS t
 FROM pf JOIN once o ON o.work_id = pf.work_id AND o.start_pos < orig_end AND o.start_pos + length(chunk_text) > orig_start), pc AS (SELECT work_id, chapter_id, sp, string_agg(t, '' ORDER BY s) AS t FROM pt GROUP BY ALL) SELECT work_id, length(string_agg(t, chr(10) || chr(10) ORDER BY sp)) AS n_chars, md5(string_agg(t, chr(10) || chr(10) ORDER BY sp)) AS text_md5 FROM pc GROUP BY 1""",
    "noise_shares": f"SELECT doc_id, removed_chars / CAST(greatest(raw_chars, 1) AS DOUBLE) AS removed_share FROM ({O.NOISE})",
    "work_noise": f"""WITH {O.ONCE}, {CHUNK_DOCS}, g AS (SELECT work_id, chunk_id, sum(length(x)) FILTER (WHERE kind NOT IN ('kept', 'blank')) AS rc, count(*) FILTER (WHERE kind NOT IN ('kept', 'blank')) AS rl, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in O.KINDS)} FROM ln GROUP BY ALL)
SELECT s.work_id, CAST(sum(length(s.t)) AS BIGINT) AS raw_chars, CAST(sum(length(b.clean)) AS BIGINT) AS clean_chars, CAST(coalesce(sum(rc), 0) AS BIGINT) AS removed_chars, CAST(coalesce(sum(rl), 0) AS BIGINT) AS removed_lines, {', '.join(f'CAST(coalesce(sum({k}), 0) AS BIGINT) AS {k}' for k in O.KINDS)}
 FROM src s JOIN base b ON b.work_id = s.work_id AND b.chunk_id = s.chunk_id LEFT JOIN g ON g.work_id = s.work_id AND g.chunk_id = s.chunk_id GROUP BY 1""",
}

READ = ["short", "short_para", "avg", "excl", "ques", "ell", "dash", "simile", "quoted", "quotes", "action", "mental", "scenery", "ttr", "pos", "neg", "act", "mind", "env", "act_per_mind", "balance", "told"]
FURTHER = {
    "style_measures": f"{MEASURES} SELECT doc_id, {', '.join(READ)} FROM me",
    "taboo_phrases": f"WITH {DOCS} " + " UNION ALL ".join(f"SELECT doc_id, {q(p)} AS phrase, {words('clean', [p])} AS n FROM base WHERE contains(clean, {q(p)})" for p in L.TABOO),
    "chunk_eras": f"{OFFSETS}, {O.ONCE} SELECT o.work_id, o.chunk_id, coalesce(min(pf.era), {q(L.UNPLACED)}) AS era FROM once o LEFT JOIN pf ON pf.work_id = o.work_id AND o.start_pos >= orig_start AND o.start_pos < orig_end GROUP BY ALL",
    "chunk_offsets": f"WITH {O.ONCE} SELECT work_id, chunk_id, CAST(coalesce(sum(length(chunk_text)) OVER (PARTITION BY work_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM once",
    "aliases": f"{SAID}, a AS (SELECT doc_id, speaker, name, count(*) AS n FROM s GROUP BY ALL) SELECT doc_id, speaker, name, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, speaker) AS k FROM a) WHERE k > 1",
    "quote_chapters": f"""WITH {O.ONCE}, {WORK_QUOTES}, ce AS (SELECT work_id, min(start_pos) AS lo, max(end_pos) AS hi FROM chapters GROUP BY 1), qa AS (SELECT w.work_id, w.chunk_id, q_no, greatest(lo, least(o.start_pos + pos, hi - 1)) AS place FROM qq_w w JOIN once o ON o.work_id = w.work_id AND o.chunk_id = w.chunk_id JOIN ce ON ce.work_id = w.work_id)
SELECT qa.work_id, qa.chunk_id, q_no, min(chapter_id) AS chapter_id FROM qa LEFT JOIN chapters c ON c.work_id = qa.work_id AND place >= c.start_pos AND place < c.end_pos GROUP BY ALL""",
}

COLUMN = {"quoted_pct": f"quoted * {D(100)}"}
LONG = f"""{MEASURES.replace("me0 AS (SELECT doc_id,", "me0 AS (SELECT doc_id, total_chars,")}, mv AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT doc_id, {q(m)} AS mid, {q(t)} AS token, {q(u)} AS unit, CAST({COLUMN.get(c, c)} AS DOUBLE) AS value FROM me" for m, t, u, c in L.METRICS)}) WHERE value IS NOT NULL)"""
TOKEN = "CASE WHEN c = '' THEN NULL WHEN list_contains({0}, c) THEN c WHEN list_contains({0}, regexp_replace(c, '_pct$', '')) THEN regexp_replace(c, '_pct$', '') ".format(O.listed([t for t, _ in L.METRIC_ALIASES])) + " ".join(f"WHEN {' OR '.join(f'contains(c, {q(a)})' for a in x)} THEN {q(t)}" for t, x in L.METRIC_ALIASES) + " END"
HEALTH = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '(?m)^###\\s+1\\.(\\d+)\\b[^\\n]*\\n', 1), lambda x: CAST(x AS INTEGER)) AS nums, string_split_regex(t, '(?m)^###\\s+1\\.\\d+\\b[^\\n]*\\n') AS parts FROM t),
h AS (SELECT doc_id, {listing({p: f"NOT regexp_matches(t, '(?m)^##[[:space:]]*[^{chr(92)}n]*{p}[^{chr(92)}n]*$')" for p in L.REPORT_PARTS})} AS missing_parts, CAST(len(list_filter(range(1, 12), lambda i: NOT list_contains(nums, i))) AS INTEGER) AS missing_sections,
 CAST(len(list_filter(parts[2:], lambda b: length({strip("string_split(b, '## 第二部分')[1]")}) < 5)) AS INTEGER) AS short_sections, CAST(length({strip('t')}) AS INTEGER) AS prose_chars FROM n) SELECT *, missing_parts = '' AND missing_sections = 0 AND short_sections = 0 AND prose_chars >= 1000 AS healthy FROM h"""
REPORT = {
    "answer_health": HEALTH,
    "metric_values": f"{LONG} SELECT * FROM mv",
    "metric_tokens": f"WITH x AS (SELECT item_id, arg_max(metric, ingested_at) AS metric FROM evidence_item GROUP BY 1), y AS (SELECT *, lower({strip('metric')}) AS c FROM x) SELECT item_id, metric, {TOKEN} AS token FROM y",
    "audited": f"""{LONG}, cl AS (SELECT doc_id, 'avg_sent_len' AS token, '20' AS written FROM documents UNION ALL SELECT doc_id, 'short_sent_ratio_pct', '30.5' FROM documents UNION ALL SELECT doc_id, 'punc_dash', '1' FROM documents UNION ALL SELECT doc_id, 'total_chars', '1,000' FROM documents)
SELECT cl.doc_id, cl.token, written, value AS measured, CASE WHEN cl.token IN ('avg_sent_len', 'short_sent_ratio_pct') THEN 'error' ELSE 'warning' END AS severity FROM cl JOIN mv ON mv.doc_id = cl.doc_id AND mv.token = cl.token
WHERE abs(CAST(replace(written, ',', '') AS DOUBLE) - value) > CASE cl.token WHEN 'avg_sent_len' THEN {D(1.5)} WHEN 'total_chars' THEN greatest(abs(value) * {D(0.02)}, {D(0.02)}) ELSE greatest(abs(value) * {D(0.08)}, {D(0.02)}) END""",
}

ORACLES = {**VOICES, **RATIOS, **CARDS, **FIDELITY, **IDENTITY, **STRUCTURE, **FURTHER, **REPORT}
