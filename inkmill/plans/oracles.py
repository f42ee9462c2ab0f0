"""SQL that computes the same results as the core queries, for an independent engine."""

from __future__ import annotations

from inkmill.functions import lexicons as L


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str, extra: str = "") -> str:
    return f"regexp_replace({x}, {q(f'^[{L.WS}{extra}]+|[{L.WS}{extra}]+$')}, '', 'g')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def chars(x: str, characters: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(characters)}, '')))"


def words(x: str, items: list[str]) -> str:
    return "(0" + "".join(f" + (length({x}) - length(replace({x}, {q(w)}, ''))) // {len(w)}" for w in items) + ")"


def parts(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(string_split_regex({x}, {q(pattern)}), lambda s: {strip('s')}), lambda s: s <> '')"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / CAST(greatest({b}, 1) AS DOUBLE))"


def total(x: str) -> str:
    return f"CAST(coalesce(list_sum({x}), 0) AS BIGINT)"


CORE = strip("y")
KIND = f"""CASE WHEN {strip('x')} = '' THEN 'blank' WHEN regexp_matches(x, {q(L.CORRUPT)}) AND length({CORE}) < 2 THEN 'corrupted_lines'
 WHEN regexp_matches({CORE}, {q(L.DIVIDER)}) THEN 'structural_dividers'
 WHEN regexp_matches({CORE}, {q(L.PLATFORM)}) OR regexp_matches({CORE}, {q(L.NAVIGATION)}) OR regexp_matches({CORE}, {q(L.LINK)})
 THEN CASE WHEN {' OR '.join(f"contains({CORE}, {q(w)})" for w in L.NOTE_WORDS)} THEN 'platform_notes' ELSE 'watermarks' END ELSE 'kept' END"""


def lines_cte(key: str, table: str, text: str = "text", where: str = "true") -> str:
    return f"""src AS (SELECT {key}, coalesce({text}, '') AS t FROM {table} WHERE {where}),
ln0 AS (SELECT {key}, t, unnest(regexp_extract_all(t, {q(L.LINE)})) AS x, generate_subscripts(regexp_extract_all(t, {q(L.LINE)}), 1) AS i FROM src),
ln1 AS (SELECT *, regexp_replace(x, {q(L.CORRUPT)}, '', 'g') AS y FROM ln0),
ln AS (SELECT *, {KIND} AS kind FROM ln1),
agg AS (SELECT {key}, string_agg(CASE kind WHEN 'blank' THEN x WHEN 'kept' THEN y ELSE '' END, '' ORDER BY i) AS clean,
 list(CASE WHEN kind = 'kept' THEN length({CORE}) ELSE 0 END ORDER BY i) AS pl FROM ln GROUP BY ALL),
base AS (SELECT {', '.join('s.' + k.strip() for k in key.split(','))}, coalesce(a.clean, '') AS clean, list_filter(coalesce(a.pl, []), lambda n: n > 0) AS paras, {parts("coalesce(a.clean, '')", L.SENTENCE)} AS sents
 FROM src s LEFT JOIN agg a USING ({key}))"""


DOCS = lines_cte("doc_id", "documents")
KINDS = ["platform_notes", "watermarks", "structural_dividers", "corrupted_lines"]

NOISE = f"""WITH {DOCS}, g AS (SELECT doc_id, sum(length(x)) FILTER (WHERE kind NOT IN ('kept','blank')) AS rc, count(*) FILTER (WHERE kind NOT IN ('kept','blank')) AS rl,
 {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in KINDS)} FROM ln GROUP BY doc_id)
SELECT s.doc_id, length(s.t) AS raw_chars, length(b.clean) AS clean_chars, CAST(coalesce(rc, 0) AS BIGINT) AS removed_chars, coalesce(rl, 0) AS removed_lines,
 {', '.join(f"coalesce({k}, 0) AS {k}" for k in KINDS)} FROM src s JOIN base b USING (doc_id) LEFT JOIN g USING (doc_id)"""

CORE_COLUMNS = f"""length(clean) AS total_chars, len(paras) AS n_paragraphs, {total('paras')} AS paragraph_chars, len(list_filter(paras, lambda n: n <= 8)) AS short_paragraphs,
 len(sents) AS n_sentences, {total('list_transform(sents, lambda s: length(s))')} AS sentence_chars, len(list_filter(sents, lambda s: length(s) <= 10)) AS short_sentences, len(list_filter(sents, lambda s: length(s) >= 50)) AS long_sentences,
 {', '.join(f"{count('clean', p)} AS n_{k}" for k, p in L.PUNCTUATION.items())}"""


def style_core(key: str, cte: str) -> str:
    avg = ratio("sentence_chars", "n_sentences")
    return f"""WITH {cte}, c AS (SELECT {key}, {CORE_COLUMNS} FROM base)
SELECT *, {avg} AS avg_sentence, {ratio('paragraph_chars', 'n_paragraphs')} AS avg_paragraph, {ratio('n_comma', 'n_period')} AS comma_per_period,
 CASE WHEN {avg} < 18 THEN 'very_short' WHEN {avg} < 25 + 1e-9 THEN 'short' WHEN {avg} < 35 + 1e-9 THEN 'medium' ELSE 'long' END AS length_bracket FROM c"""


BANDS = [("le10", 0, 10), ("le20", 10, 20), ("le30", 20, 30), ("le50", 30, 50), ("more", 50, 10**9)]
SENTENCE_STATS = f"""WITH {DOCS}, v AS (SELECT doc_id, list_sort(list_transform(sents, lambda s: length(s))) AS v, len(sents) AS n FROM base),
w AS (SELECT *, {total('v')} AS s, {total('list_transform(v, lambda x: x * x)')} AS q FROM v)
SELECT doc_id, n AS n_sentences, CASE WHEN n > 0 THEN CAST((v[(n + 1) // 2] + v[n // 2 + 1]) / 2.0 AS DOUBLE) END AS median_length, CASE WHEN n > 0 THEN v[1] END AS min_length, CASE WHEN n > 0 THEN v[n] END AS max_length,
 CASE WHEN n > 0 THEN sqrt(CAST(n * q - s * s AS DOUBLE)) / CAST(n AS DOUBLE) END AS deviation,
 {', '.join(f"len(list_filter(v, lambda x: x > {a} AND x <= {b})) AS n_{k}" for k, a, b in BANDS)} FROM w"""

PLAIN = "replace(replace(clean, '其他', ''), '其它', '')"
RHETORIC = f"""WITH {DOCS}, r AS (SELECT doc_id, {count('clean', L.SCENE_TIME)} + {count('clean', L.SCENE_MOVE)} AS scene_cues, {count('clean', L.RHETORICAL)} AS rhetorical_questions, {count('clean', L.PARALLEL)} AS parallel_phrases,
 {chars(PLAIN, L.THIRD)} AS third_person, {chars(PLAIN, L.FIRST)} + {words(PLAIN, L.FIRST_WORDS)} AS first_person, {chars('clean', L.FIRST)} AS first_markers, {chars('clean', L.THIRD)} + {words('clean', ['他们', '她们'])} AS third_markers FROM base)
SELECT *, CASE WHEN third_person >= 2 * first_person THEN 'third' WHEN first_person > third_person THEN 'first' ELSE 'mixed' END AS person,
 CASE WHEN first_markers + third_markers = 0 THEN 'none' WHEN 4 * greatest(first_markers, third_markers) > 3 * (first_markers + third_markers) THEN 'stable' ELSE 'shifting' END AS person_stability FROM r"""

# the other engine's expressions have no look-around: matches are listed with their neighbours and judged by them
RU = f"""len(list_filter(regexp_extract_all(s, {q(f'(?:^|[^{L.RU_BEFORE}])(如(?:[^如]{{0,2}}))')}, 1), lambda m: regexp_matches(m[2:2], {q('^' + L.CJK)}) AND NOT contains({q(L.RU_AFTER)}, m[2:2])
 AND NOT regexp_matches(m[2:], {q(f'^(?:一(?:[^一-龥]|$|[{L.RU_ONE}])|既往|往[日前昔常]|从[前来])')}))) > 0"""
XIANG = f"regexp_matches(s, {q(f'(?:^|[^{L.XIANG_BEFORE}])像{L.CJK}')})"
SIMILE = f"(regexp_matches(s, {q('|'.join(L.SIMILE_MARKERS))}) OR {RU} OR {XIANG})"
SIMILES = f"""WITH {DOCS}, s0 AS (SELECT doc_id, unnest(sents) AS s FROM base), s1 AS (SELECT doc_id, regexp_replace(s, '^[，、；：]+|[，、；：]+$', '', 'g') AS s FROM s0),
s2 AS (SELECT doc_id, regexp_replace(s, {q(L.NOT_LIKE)}, '', 'g') AS s FROM s1 WHERE length(s) BETWEEN 8 AND 80), n AS (SELECT doc_id, count(*) AS similes FROM s2 WHERE {SIMILE} GROUP BY doc_id)
SELECT doc_id, coalesce(similes, 0) AS similes, length(clean) AS total_chars FROM base LEFT JOIN n USING (doc_id)"""

MIX = f"""m0 AS (SELECT doc_id, unnest(sents) AS s FROM base), m1 AS (SELECT doc_id, {chars('s', L.ACTION_CHARS)} + {words('s', L.ACTION_WORDS)} AS a, {chars('s', L.MENTAL_CHARS)} + {words('s', L.MENTAL_WORDS)} AS m, {chars('s', L.SCENERY_CHARS)} AS e FROM m0),
m2 AS (SELECT doc_id, CASE WHEN e > greatest(a, m) AND e >= 2 THEN 'scenery' WHEN greatest(a, m, e) = 0 THEN 'none' WHEN a >= m AND a >= e THEN 'action' WHEN m >= e THEN 'mind' ELSE 'scenery' END AS k FROM m1),
m3 AS (SELECT doc_id, count(*) FILTER (WHERE k = 'action') AS action, count(*) FILTER (WHERE k = 'mind') AS mind, count(*) FILTER (WHERE k = 'scenery') AS scenery FROM m2 GROUP BY doc_id),
mix AS (SELECT doc_id, coalesce(action, 0) AS action, coalesce(mind, 0) AS mind, coalesce(scenery, 0) AS scenery FROM base LEFT JOIN m3 USING (doc_id))"""
APM = ratio("action", "mind")
DESCRIPTION = f"WITH {DOCS}, {MIX} SELECT *, {APM} AS action_per_mind, CASE WHEN {APM} >= 3 THEN 'action' WHEN {APM} >= 1.2 THEN 'balanced' ELSE 'mind' END AS driver FROM mix"


def present(items: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(clean, {q(w)}) AS BIGINT)" for w in items) + ")"


ASL, AWL = ratio("total_chars", "n_sentences"), ratio("word_chars", "n_words")
SCORE = f"(CASE WHEN {ASL} < 15 THEN 1 WHEN {ASL} < 25 THEN 2 WHEN {ASL} < 40 THEN 3 ELSE 4 END + CASE WHEN {AWL} < 2 THEN 1 WHEN {AWL} < 3 THEN 2 WHEN {AWL} < 4 THEN 3 ELSE 4 END + 1)"
CLAUSES = f"list_transform(s, lambda x: greatest(len({parts('x', L.CLAUSE).replace('lambda s:', 'lambda z:').replace('(s,', '(z,').replace('s <>', 'z <>')}), 1))"
LOW_LEVEL = f"""WITH {DOCS}, r AS (SELECT *, list_transform(regexp_extract_all(clean, {q(L.CJK + '{2,}')}), lambda r: length(r)) AS runs, {parts('clean', L.LOW_SENTENCE)} AS s FROM base),
c AS (SELECT doc_id, length(clean) AS total_chars, {total('list_transform(runs, lambda n: n - 1 + n % 2)')} AS n_words, {total('list_transform(runs, lambda n: 2 * (n - 1) + n % 2)')} AS word_chars, len(s) AS n_sentences,
 {total(CLAUSES)} AS n_clauses, coalesce(list_max({CLAUSES}), 0) AS most_clauses, {total(f"list_transform(s, lambda x: {count('x', L.SUBORDINATE)})")} AS subordinate, {total(f"list_transform(s, lambda x: {count('x', L.COORDINATE)})")} AS coordinate,
 {present(L.POSITIVE)} AS positive, {present(L.NEGATIVE)} AS negative, {present(L.SYSTEM_WORDS)} AS system_words FROM r)
SELECT *, {ASL} AS avg_sentence, {AWL} AS avg_word, CAST(0.4 AS DOUBLE) * {ASL} AS yang_index, greatest(CAST(0 AS DOUBLE), CAST(0.39 AS DOUBLE) * {ASL} + CAST(11.8 AS DOUBLE) * {AWL} - CAST(15.59 AS DOUBLE)) AS grade_index,
 CAST(0.4 AS DOUBLE) * {ratio('n_words', 'n_sentences')} AS fog_index, CASE WHEN {SCORE} * 2 < 9 THEN 'simple' WHEN {SCORE} * 2 < 15 THEN 'medium' WHEN {SCORE} * 2 < 21 THEN 'hard' ELSE 'very_hard' END AS readability,
 CASE WHEN 5 * (positive - negative) > positive + negative THEN 'positive' WHEN 5 * (negative - positive) > positive + negative THEN 'negative' ELSE 'neutral' END AS tone FROM c"""

TOKENS = f"""{DOCS}, runs AS (SELECT doc_id, unnest(regexp_extract_all(clean, {q(L.CJK + '{2,}')})) AS r FROM base),
tok AS (SELECT doc_id, substr(r, i, 2) AS word FROM (SELECT doc_id, r, unnest(range(1, length(r))) AS i FROM runs) UNION ALL SELECT doc_id, right(r, 1) FROM runs WHERE length(r) % 2 = 1),
cnt AS (SELECT doc_id, word, count(*) AS n FROM tok GROUP BY ALL)"""
VOCABULARY = f"""WITH {TOKENS} SELECT doc_id, CAST(sum(n) AS BIGINT) AS total_words, count(*) AS unique_words, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n = 2) AS twice, count(*) FILTER (WHERE n > 2) AS oftener, max(n) AS most,
 {ratio('count(*)', 'sum(n)')} AS type_token_ratio FROM cnt GROUP BY doc_id"""
TOP_WORDS = f"WITH {TOKENS} SELECT doc_id, word, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word)) AS rank FROM cnt) WHERE rank <= 20 AND length(word) > 1"


def some(pairs: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {p} THEN {q(n)} END" for n, p in pairs) + "], lambda x: x IS NOT NULL), ',')"


def per(k: str) -> str:
    return f"n_{k} * CAST(1000 AS DOUBLE) / CAST(greatest(total_chars, 1) AS DOUBLE)"


D = "CAST({} AS DOUBLE)".format
RULES = [("X1", "short > 30 AND excl > 5"), ("X2", "short > 30 AND excl < 2"), ("X6", "mind > 30 AND excl < 3"), ("X7", "act > 50 AND short > 25"), ("X8", "env > 25 AND avg > 30")]
LABELS = [
    ("轻松搞笑型", "short > 35 AND excl > 5"), ("冷静快节奏型", "short > 30 AND excl < 2"), ("推理驱动型", f"ques > 5 AND excl < ques * {D(0.5)}"), ("动作快节奏型", "act > 60 AND short > 20"), ("内省克制型", "mind > 35 AND excl < 3"),
    ("铺陈留白型", "avg > 35 AND ell > 2"), ("热血爆发型", "excl > 8 AND short > 25"), ("极简利落型", "avg < 20 AND short > 35"), ("克制写实型", f"ell < {D(0.3)} AND excl < 2"), ("悬疑动作型", "ques > 3 AND act > 50"),
]
WARM = f"least({D(0.95)}, greatest({D(0.65)}, CASE WHEN short > 25 THEN {D(0.85)} + least({D('0.10')}, (short - 25) * {D(0.004)}) WHEN short >= 15 THEN {D(0.75)} + (short - 15) * {D(0.01)} ELSE {D(0.7)} + short * {D(0.005)} END))"
STYLE_LABELS = f"""WITH {DOCS}, {MIX}, c AS (SELECT doc_id, {CORE_COLUMNS} FROM base), j AS (SELECT c.*, action, mix.mind AS md, scenery, action + mix.mind + scenery AS dsc FROM c JOIN mix USING (doc_id)),
m AS (SELECT doc_id, short_sentences * {D(100)} / CAST(greatest(n_sentences, 1) AS DOUBLE) AS short, {per('exclamation')} AS excl, {per('question')} AS ques, {per('ellipsis')} AS ell, {ratio('sentence_chars', 'n_sentences')} AS avg,
 CASE WHEN dsc > 0 THEN action * {D(100)} / CAST(dsc AS DOUBLE) END AS act, CASE WHEN dsc > 0 THEN md * {D(100)} / CAST(dsc AS DOUBLE) END AS mind, CASE WHEN dsc > 0 THEN scenery * {D(100)} / CAST(dsc AS DOUBLE) END AS env FROM j)
SELECT doc_id, {some(RULES)} AS signals, {some(LABELS)} AS labels, CASE WHEN excl > 8 THEN least({D(0.95)}, {WARM} + {D(0.05)}) ELSE {WARM} END AS temperature FROM m"""

ONCE = "once AS (SELECT work_id, chunk_id, arg_max(seq, ingested_at) AS seq, arg_max(start_pos, ingested_at) AS start_pos, arg_max(chunk_text, ingested_at) AS chunk_text, arg_max(era, ingested_at) AS era FROM evidence_store GROUP BY ALL)"
CHAPTER_INDEX = f"""WITH {ONCE}, l0 AS (SELECT work_id, start_pos, regexp_extract_all(chunk_text, {q(L.LINE)}) AS l FROM once),
l1 AS (SELECT work_id, start_pos, l, unnest(range(1, len(l) + 1)) AS i FROM l0),
h AS (SELECT DISTINCT work_id, start_pos + {total('list_transform(l[1:i - 1], lambda x: length(x))')} AS pos, {strip('l[i]')} AS title FROM l1 WHERE regexp_matches({strip('l[i]')}, {q(L.HEADING)})),
p AS (SELECT work_id, pos, min(title) AS title FROM h GROUP BY ALL), e AS (SELECT work_id, max(start_pos + length(chunk_text)) AS work_end FROM evidence_store GROUP BY 1),
w AS (SELECT *, lead(pos) OVER (PARTITION BY work_id ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY work_id ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY work_id) AS n FROM p)
SELECT work_id, CAST(idx AS INTEGER) AS chapter_idx, title, pos AS start_pos, coalesce(nxt, work_end) AS end_pos FROM w JOIN e USING (work_id) WHERE n >= 2"""
CHUNK_CHAPTERS = f"WITH {ONCE} SELECT o.work_id, o.chunk_id, min(c.chapter_id) AS chapter_id FROM once o LEFT JOIN chapters c ON c.work_id = o.work_id AND o.start_pos >= c.start_pos AND o.start_pos < c.end_pos GROUP BY ALL"
VOLUME_ASOF = "SELECT work_id, chapter_id, last_value(volume IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY chapter_idx ROWS UNBOUNDED PRECEDING) AS volume FROM chapters"
FALLBACK = "SELECT doc_id, CAST(k // 4000 + 1 AS INTEGER) AS part_no, CAST(k AS INTEGER) AS start_pos, CAST(least(k + 4000, n) AS INTEGER) AS end_pos FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text), 4000)) AS k FROM documents WHERE length(text) > 0)"


def listed(items: list) -> str:
    return "[" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in items) + "]"


READING_PLAN = f"""WITH b AS (SELECT work_id, chapter_id, chapter_idx AS idx, n_chars AS len, count(*) OVER (PARTITION BY work_id) AS n, sum(n_chars) OVER (PARTITION BY work_id) AS chars FROM chapters),
era AS (SELECT unnest(range(0, 5)) AS e, unnest({listed(L.ERAS)}) AS era),
small AS (SELECT work_id, idx, chapter_id, {listed([L.ERA_CHOICE[k] for k in range(1, 6)])}[least(n, 5)][CAST(least(idx * least(n, 5) // n, least(n, 5) - 1) AS INTEGER) + 1] AS e FROM b WHERE chars <= 150000 OR n <= 5),
cut AS (SELECT *, CAST(floor(n * CAST(0.15 AS DOUBLE)) AS INT) AS c1, CAST(floor(n * CAST(0.40 AS DOUBLE)) AS INT) AS c2, CAST(floor(n * CAST(0.65 AS DOUBLE)) AS INT) AS c3, CAST(floor(n * CAST(0.85 AS DOUBLE)) AS INT) AS c4 FROM b WHERE NOT (chars <= 150000 OR n <= 5)),
span AS (SELECT work_id, idx, chapter_id, len, e, [0, c1, c2, c3, c4][e + 1] AS a, [greatest(1, c1), greatest(c1 + 1, c2), greatest(c2 + 1, c3), greatest(c3 + 1, c4), n][e + 1] AS z FROM cut, era),
large AS (SELECT *, CASE e WHEN 0 THEN a WHEN 4 THEN greatest(a, z - 2) ELSE a + (z - a) // 2 END AS pick FROM span WHERE idx >= a AND idx < z),
lab AS (SELECT work_id, idx, min(e) AS e FROM large GROUP BY ALL),
ah0 AS (SELECT *, row_number() OVER w AS rn, sum(len) OVER w AS acc FROM large WHERE idx >= pick WINDOW w AS (PARTITION BY work_id, e ORDER BY idx ROWS UNBOUNDED PRECEDING)),
ah AS (SELECT *, count(*) OVER (PARTITION BY work_id, e) AS got FROM ah0 WHERE acc - len < 30000 OR rn <= 2),
bk AS (SELECT l.work_id, l.idx, l.chapter_id FROM (SELECT *, row_number() OVER (PARTITION BY work_id, e ORDER BY idx DESC) AS rn FROM large WHERE idx < pick) l JOIN (SELECT DISTINCT work_id, e, got FROM ah) g ON g.work_id = l.work_id AND g.e = l.e WHERE l.rn <= 2 - g.got),
pk AS (SELECT work_id, idx, chapter_id FROM ah WHERE acc <= 45000 OR rn <= 2 OR e = 4 UNION SELECT * FROM bk)
SELECT work_id, idx AS chapter_idx, chapter_id, era FROM (SELECT * FROM small UNION ALL SELECT pk.work_id, pk.idx, pk.chapter_id, lab.e FROM pk JOIN lab USING (work_id, idx)) x JOIN era USING (e)"""

FOLD = f"""WITH RECURSIVE s AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), {q(L.LINE)}), lambda x: length(x)) AS n FROM documents),
r AS (SELECT doc_id, n, 0 AS i, CAST(0 AS BIGINT) AS acc, CAST(0 AS BIGINT) AS start_pos, 0 AS k, CAST(NULL AS BIGINT) AS shut, CAST(0 AS BIGINT) AS pos FROM s WHERE len(n) > 0
 UNION ALL SELECT doc_id, n, i + 1, CASE WHEN acc + n[i + 1] >= 2000 THEN 0 ELSE acc + n[i + 1] END, start_pos, k + CASE WHEN acc + n[i + 1] >= 2000 OR i + 1 = len(n) THEN 1 ELSE 0 END,
 CASE WHEN acc + n[i + 1] >= 2000 OR i + 1 = len(n) THEN acc + n[i + 1] END, pos + n[i + 1] FROM r WHERE i < len(n))
SELECT doc_id, printf('c%03d', k) AS chunk_id, pos - shut AS start_pos, shut AS n_chars FROM r WHERE shut IS NOT NULL AND shut > 0"""

SHORT = "regexp_replace({}, '^(.{{2,}}?)(?:" + "|".join(sorted(L.ADVERBS, key=len, reverse=True)) + ")$', '\\1')"
VERB = "regexp_replace({}, '^(.{{2,}}?)(?:" + "|".join(sorted(L.VERB_TAILS, key=len, reverse=True)) + ")$', '\\1')"
EDGE = rf"，。！？…—{L.WS}"
LEAD = "^(?:在|向|对|朝|冲|随着|只听|听到|忽听|便听|却见|只见)"


def bare(x: str) -> str:
    return f"CASE WHEN length({x}) < 4 THEN {x} WHEN regexp_matches({x}, '^(.{{3,}}?)(?:的|地|着)$') THEN left({x}, length({x}) - 1) ELSE {SHORT.format(x)} END"


def names_ok(x: str) -> str:
    return f"(length({x}) BETWEEN 2 AND 4 AND NOT list_contains({listed(L.NO_NAMES)}, {x}) AND NOT regexp_matches({x}, {q(f'[{L.NAME_STOPS}]')}))"


TAGS = sorted(L.SPEECH_TAGS, key=lambda t: (-len(t), t))


def side(s: str) -> str:
    return f"""{s}0 AS (SELECT doc_id, q_no, {s} AS w, CASE WHEN NOT ({' OR '.join(f"contains({s}, {q(t)})" for t in L.NO_TAGS)}) THEN list_filter({listed(TAGS)}, lambda t: contains({s}, t))[1] END AS tag FROM qs),
{s}1 AS (SELECT *, {strip('substr(w, 1, instr(w, tag) - 1)')} AS c FROM {s}0), {s}2 AS (SELECT doc_id, q_no, tag, {strip(f"regexp_replace(regexp_replace(c, {q(f'^[{EDGE}]+|[{EDGE}]+$')}, '', 'g'), {q(LEAD)}, '')")} AS n0 FROM {s}1),
{s}6 AS (SELECT *, list_reduce(list_concat([n0], list_transform(range(12), lambda i: '')), lambda x, y: {bare('x')}) AS n4 FROM {s}2),
{s}9 AS (SELECT doc_id, q_no, tag AS {s}_tag, CASE WHEN {names_ok('n0')} THEN n0 WHEN {names_ok('n4')} THEN n4 END AS {s}_name FROM {s}6)"""


QUOTED = f"""{DOCS}, q0 AS (SELECT doc_id, clean, string_split_regex(clean, {q(L.QUOTE)}) AS o, regexp_extract_all(clean, {q(L.QUOTE)}) AS m FROM base),
q1 AS (SELECT doc_id, clean, o, m, unnest(range(1, len(m) + 1)) AS i FROM q0),
q2 AS (SELECT doc_id, clean, i AS q_no, {total('list_transform(o[1:i], lambda x: length(x))')} + {total('list_transform(m[1:i - 1], lambda x: length(x))')} AS pos, m[i] AS q FROM q1),
qs AS (SELECT doc_id, q_no, pos, {strip('substr(q, 2, length(q) - 2)')} AS content, {strip('substr(clean, greatest(pos - 12, 0) + 1, pos - greatest(pos - 12, 0))')} AS lft, {strip('substr(clean, pos + length(q) + 1, 12)')} AS rgt FROM q2 WHERE {strip('substr(q, 2, length(q) - 2)')} <> ''),
{side('lft')}, {side('rgt')},
qq AS (SELECT doc_id, q_no, pos, content, pos // 1000 AS block, coalesce(lft_name, rgt_name) AS name, CASE WHEN lft_name IS NOT NULL THEN lft_tag WHEN rgt_name IS NOT NULL THEN rgt_tag ELSE coalesce(lft_tag, rgt_tag) END AS tag
 FROM qs JOIN lft9 USING (doc_id, q_no) JOIN rgt9 USING (doc_id, q_no))"""
FUNCTION = "CASE " + " ".join(f"WHEN regexp_matches(content, {q(w)}) THEN {q(n)}" for n, w in L.FUNCTIONS) + " ELSE '信息交换' END"
PUNCT = "“”\"'「」『』…—，。！？!:：;；,、 "
SPEAKERS = f"""WITH {QUOTED}, s0 AS (SELECT *, regexp_replace(name, {q(f'^[{PUNCT}]+|[{PUNCT}]+$')}, '', 'g') AS v0 FROM qq WHERE name IS NOT NULL),
{', '.join(f"s{i + 1} AS (SELECT * EXCLUDE (v{i}), CASE WHEN length(v{i}) > 2 THEN {VERB.format(f'v{i}')} ELSE v{i} END AS v{i + 1} FROM s{i})" for i in range(4))},
s AS (SELECT *, v4 AS speaker FROM s4 WHERE v4 <> '' AND NOT list_contains({listed(['她', '他', '它', '她俩', '他俩', *L.NO_NAMES])}, v4) AND NOT (length(v4) = 2 AND regexp_matches(v4, '^[她他它]')) AND NOT regexp_matches(v4, '[的了吗呢吧啊呀哦嘛]') AND regexp_matches(v4, '^[\\x{{4e00}}-\\x{{9fa5}}A-Za-z·]{{2,6}}$')),
t AS (SELECT doc_id, speaker, tag AS fav_tag FROM (SELECT doc_id, speaker, tag, row_number() OVER (PARTITION BY doc_id, speaker ORDER BY count(*) DESC, min(q_no)) AS r FROM s GROUP BY doc_id, speaker, tag) WHERE r = 1),
p AS (SELECT doc_id, speaker, count(*) AS lines, count(DISTINCT block) AS blocks, sum(length(substr(content, 1, 50))) AS chars, count(*) FILTER (WHERE regexp_matches(content, '[？?]$')) AS asks, count(*) FILTER (WHERE regexp_matches(content, '[！!]$')) AS exclaims, count(DISTINCT name) AS spellings FROM s GROUP BY ALL)
SELECT doc_id, speaker, lines, blocks, CAST(chars AS DOUBLE) / lines AS avg_line, fav_tag, spellings, CASE WHEN asks * 10 > lines * 3 THEN 'asking' WHEN exclaims * 5 > lines THEN 'commanding' ELSE 'stating' END AS tone,
 CASE WHEN lines >= 3 AND blocks >= 2 THEN 'high' ELSE 'low' END AS confidence FROM p JOIN t USING (doc_id, speaker)"""

ERA_CTE = lines_cte("work_id, chunk_id, era", "(SELECT DISTINCT work_id, chunk_id, era, chunk_text FROM evidence_store)", "chunk_text", "list_contains(" + listed(L.ERAS) + ", era)")
ERA_MEASURES = f"""WITH {ERA_CTE}, c AS (SELECT work_id, era, {CORE_COLUMNS} FROM base)
SELECT work_id, era, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('long_sentences', 'n_paragraphs', 'n_sentences', 'paragraph_chars', 'sentence_chars', 'short_sentences'))} FROM c GROUP BY work_id, era"""
ERA_TRENDS = f"""WITH em AS ({ERA_MEASURES}), m AS (SELECT work_id, list_position({listed(L.ERAS)}, era) AS p, unnest(['avg_sentence', 'short_share', 'long_share', 'avg_paragraph']) AS measure,
 unnest([{ratio('sentence_chars', 'n_sentences')}, {ratio('short_sentences', 'n_sentences')}, {ratio('long_sentences', 'n_sentences')}, {ratio('paragraph_chars', 'n_paragraphs')}]) AS v FROM em),
s AS (SELECT work_id, measure, list(v ORDER BY p) AS v FROM m GROUP BY ALL), t AS (SELECT *, len(v) AS n, list_sum(v) / len(v) AS mean, list_max(v) - list_min(v) AS span, v[len(v)] - v[1] AS net, list_sum(list_transform(range(2, len(v) + 1), lambda i: abs(v[i] - v[i - 1]))) AS path FROM s)
SELECT work_id, measure, CAST(n AS INTEGER) AS eras, CASE WHEN n < 2 THEN 'too_few' WHEN span = 0 THEN 'steady' WHEN mean = 0 THEN 'shifting' WHEN span / abs(mean) <= CAST(0.10 AS DOUBLE) THEN 'steady' WHEN abs(net) / path >= 0.5 THEN CASE WHEN net > 0 THEN 'rising' ELSE 'falling' END ELSE 'shifting' END AS trend FROM t"""

MAD = """WITH r AS (SELECT doc_kind, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE n_chars IS NOT NULL AND doc_kind IS NOT NULL), m AS (SELECT doc_kind, median(v) AS med, count(*) AS n FROM r GROUP BY 1),
d AS (SELECT doc_kind, median(abs(v - med)) AS mad FROM r JOIN m USING (doc_kind) GROUP BY 1), w AS (SELECT doc_kind, n, med, CASE WHEN mad <> 0 THEN mad WHEN med <> 0 THEN abs(med) * CAST(0.05 AS DOUBLE) ELSE 0.5 END AS k FROM m JOIN d USING (doc_kind) WHERE n >= 4)
SELECT doc_kind, n, med AS median, greatest(CAST(0 AS DOUBLE), med - 3 * k) AS low, med + 3 * k AS high FROM w"""


def share_cte(n: int) -> str:
    return f"""r{n} AS (SELECT DISTINCT substr(text, i, {n}) AS g FROM (SELECT text, unnest(range(1, length(text) - {n - 2})) AS i FROM eval_items)),
o{n} AS (SELECT doc_id, substr(text, i, {n}) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - {n - 2})) AS i FROM trial)), s{n} AS (SELECT doc_id, count(*) FILTER (WHERE r{n}.g IS NOT NULL) AS shared_{n}, count(*) AS total_{n} FROM o{n} LEFT JOIN r{n} ON r{n}.g = o{n}.g GROUP BY 1)"""


COPY = f"""WITH trial AS (SELECT doc_id, text FROM documents WHERE doc_kind = 'trial'), {', '.join(map(share_cte, (5, 7, 40)))},
j AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, {', '.join(f'coalesce(shared_{n}, 0) AS shared_{n}, coalesce(total_{n}, 0) AS total_{n}' for n in (5, 7, 40))} FROM trial LEFT JOIN s5 USING (doc_id) LEFT JOIN s7 USING (doc_id) LEFT JOIN s40 USING (doc_id))
SELECT *, shared_40 > 0 OR (shared_5 * 100 >= total_5 * 35 AND shared_7 * 100 >= total_7 * 15 AND n_chars >= 200) AS at_risk FROM j"""
SCENES = f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), {q(r'(?m)^[ \t\x{3000}]*(?:-{3,}|={3,})[ \t\x{3000}\r]*$')}), lambda s: length({strip('s')})), lambda n: n > 0) AS p FROM documents)
SELECT doc_id, CAST(len(p) AS INTEGER) AS n_scenes, coalesce(list_min(p), 0) AS shortest, len(p) BETWEEN 2 AND 3 AND coalesce(list_min(p), 0) >= 800 AS meets FROM p"""


def normal(x: str) -> str:
    return f"replace(translate(regexp_replace({x}, {q(f'[{L.WS}]+')}, '', 'g'), '“”‘’—', {q(chr(34) * 2 + chr(39) * 2 + '-')}), '…', '...')"


VERIFY = f"""WITH {ONCE}, t AS (SELECT work_id, chunk_id, seq, {normal('chunk_text')} AS t FROM once), i0 AS (SELECT DISTINCT ON (item_id) item_id, work_id, lower(trim(chunk_id)) AS cited, coalesce({normal('quote')}, '') AS q FROM evidence_item ORDER BY item_id, ingested_at DESC),
v AS (SELECT i0.item_id, 'valid' AS status, t.chunk_id FROM i0 JOIN t ON t.work_id = i0.work_id AND t.chunk_id = cited WHERE length(q) >= 6 AND contains(t.t, q)),
f AS (SELECT i0.item_id, 'fixed' AS status, min_by(t.chunk_id, t.seq) AS chunk_id FROM i0 JOIN t ON t.work_id = i0.work_id AND contains(t.t, q) WHERE length(q) >= 6 AND i0.item_id NOT IN (SELECT item_id FROM v) GROUP BY 1)
SELECT item_id, coalesce(status, 'downgraded') AS status, chunk_id FROM i0 LEFT JOIN (SELECT * FROM v UNION ALL SELECT * FROM f) x USING (item_id)"""
CODES = """WITH s AS (SELECT work_id, regexp_replace(coalesce(author_name, '') || '|' || coalesce(title, ''), '^\\|+|\\|+$', '', 'g') AS seed FROM works)
SELECT work_id, CASE WHEN seed = '' THEN 'WORK_UNKNOWN' ELSE 'WORK_' || upper(substr(sha256(seed), 1, 6)) END AS code FROM s"""
TERMS = f"tm AS (SELECT work_id, 'author' AS kind, {strip('author_name')} AS term FROM works UNION ALL SELECT work_id, 'title', {strip('title')} FROM works)"
LEAKS = f"WITH {ONCE}, {TERMS} SELECT work_id, chunk_id, kind, (length(chunk_text) - length(replace(chunk_text, term, ''))) // length(term) AS hits FROM once JOIN tm USING (work_id) WHERE length(term) >= 2 AND contains(chunk_text, term)"
MASKED = f"""WITH {ONCE}, {TERMS}, n AS (SELECT work_id, max(term) FILTER (WHERE kind = 'author') AS a, max(term) FILTER (WHERE kind = 'title') AS t FROM tm WHERE length(term) >= 2 GROUP BY 1),
x AS (SELECT o.work_id, o.chunk_id, o.chunk_text AS c, a, t, length(coalesce(t, '')) >= length(coalesce(a, '')) AS first FROM once o LEFT JOIN n USING (work_id)),
y AS (SELECT *, CASE WHEN first THEN CASE WHEN t IS NULL THEN c ELSE replace(c, t, chr(57345)) END ELSE CASE WHEN a IS NULL THEN c ELSE replace(c, a, chr(57344)) END END AS c1 FROM x),
z AS (SELECT work_id, chunk_id, CASE WHEN first THEN CASE WHEN a IS NULL THEN c1 ELSE replace(c1, a, chr(57344)) END ELSE CASE WHEN t IS NULL THEN c1 ELSE replace(c1, t, chr(57345)) END END AS c2 FROM y),
o AS (SELECT work_id, chunk_id, replace(replace(c2, chr(57344), '某作者'), chr(57345), '某书') AS m FROM z)
SELECT work_id, chunk_id, length(m) AS n_chars, md5(m) AS masked_md5 FROM o"""

BROKEN = "regexp_matches(s, '……[^…\\n]')"
GARBLED = f"(NOT regexp_matches(s, {q(L.DIALOGUE_LINE)}) AND length(s) > 12 AND NOT regexp_matches(s, {q(L.FUNCTION_WORD)}))"
SIMILE_RAW = SIMILE.replace("regexp_extract_all(s,", "regexp_extract_all(sr,").replace("regexp_matches(s,", "regexp_matches(sr,")
ANCHOR_CTE = f"""{ONCE}, st AS (SELECT work_id, chunk_id, era, string_split_regex(chunk_text, {q(L.SENTENCE)}) AS l, regexp_extract_all(chunk_text, {q(L.LINE)}) AS w FROM once),
ss AS (SELECT work_id, chunk_id, era, i, regexp_replace({strip('l[i]')}, '^[，、；：]+|[，、；：]+$', '', 'g') AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM st)),
sr AS (SELECT *, regexp_replace(s, {q(L.NOT_LIKE)}, '', 'g') AS sr FROM ss), wl AS (SELECT work_id, chunk_id, era, i, {strip('w[i]')} AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM st)),
wt AS (SELECT work_id, chunk_id, era, i, regexp_replace(s, '^[，、；： ]+|[，、；： ]+$', '', 'g') AS s FROM wl),
hit AS (SELECT *, 0 AS k, 'metaphor' AS type FROM (SELECT work_id, chunk_id, era, i, s FROM sr WHERE length(s) BETWEEN 8 AND 80 AND {SIMILE_RAW} AND NOT {GARBLED})
 UNION ALL SELECT *, 1, 'dash' FROM ss WHERE length(s) BETWEEN 8 AND 60 AND contains(s, '——') AND NOT {BROKEN} UNION ALL SELECT *, 2, 'ellipsis' FROM ss WHERE length(s) BETWEEN 8 AND 60 AND {BROKEN}
 UNION ALL SELECT *, 3, 'tag' FROM wl WHERE length(s) <= 80 AND (regexp_matches(s, {q(L.TAG_FRONT)}) OR regexp_matches(s, {q(L.TAG_REAR)})) UNION ALL SELECT *, 4, 'short_para' FROM wt WHERE length(s) BETWEEN 2 AND 8 AND regexp_matches(s, '[。！？]$')
 UNION ALL SELECT *, 5, 'example' FROM ss WHERE length(s) BETWEEN 8 AND 60 AND regexp_matches(s, {q(L.EXAMPLE)})),
one AS (SELECT work_id, chunk_id, era, k, type, s FROM (SELECT *, row_number() OVER (PARTITION BY work_id, chunk_id, k ORDER BY i) AS r FROM hit) WHERE r = 1 AND (k IN (0, 4) OR NOT {GARBLED}))"""
ANCHORS = f"WITH {ANCHOR_CTE} SELECT work_id, chunk_id, era, CAST(k AS INTEGER) AS k, type, s AS quote FROM one"
POOL = f"""WITH {ANCHOR_CTE}, c AS (SELECT *, row_number() OVER (PARTITION BY work_id, chunk_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY work_id, chunk_id) AS m, list_sum(list_transform(string_split(chunk_id, ''), lambda x: ord(x))) AS code FROM one),
g AS (SELECT *, ((i - code % m) % m + m) % m AS turn FROM c WHERE length(s) >= 6), rd AS (SELECT work_id, chunk_id, row_number() OVER (PARTITION BY work_id, era ORDER BY chunk_id) AS rnd FROM once), ne AS (SELECT work_id, count(DISTINCT era) AS eras FROM once GROUP BY 1),
a AS (SELECT *, row_number() OVER (PARTITION BY work_id, era ORDER BY rnd, turn) AS r FROM g JOIN rd USING (work_id, chunk_id) JOIN ne USING (work_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY rnd, encode(era), turn) AS rank FROM a WHERE r <= ceil(28.0 / eras)) SELECT work_id, printf('E%04d', rank) AS evidence_id, chunk_id, era, type, s AS quote FROM b WHERE rank <= 28"""

ORACLES = {
    "noise_stats": NOISE, "style_core": style_core("doc_id", DOCS), "sentence_stats": SENTENCE_STATS, "rhetoric": RHETORIC, "similes": SIMILES, "description_mix": DESCRIPTION,
    "low_level": LOW_LEVEL, "vocabulary_richness": VOCABULARY, "top_words": TOP_WORDS, "style_labels": STYLE_LABELS,
    "chapter_index": CHAPTER_INDEX, "chunk_chapters": CHUNK_CHAPTERS, "volume_asof": VOLUME_ASOF, "fallback_chapters": FALLBACK, "reading_plan": READING_PLAN, "fold_chunks": FOLD,
    "quotes": f"WITH {QUOTED} SELECT * FROM qq", "speakers": SPEAKERS, "dialogue_functions": f"WITH {QUOTED} SELECT doc_id, {FUNCTION} AS function, count(*) AS n FROM qq GROUP BY ALL", "tag_counts": f"WITH {QUOTED} SELECT tag, count(*) AS n FROM qq WHERE tag IS NOT NULL GROUP BY tag",
    "era_measures": ERA_MEASURES, "era_trends": ERA_TRENDS, "mad_bands": MAD, "copy_risk": COPY, "scenes": SCENES,
    "evidence_verify": VERIFY, "work_codes": CODES, "leak_scan": LEAKS, "masked": MASKED, "anchors": ANCHORS, "evidence_pool": POOL,
}
