"""Oracle SQL: the same results from plain SQL over the same tables.

Written from the rules, not from the DataFrame code: folds and greedy clustering are
recursive queries, question blocks are window queries.
"""

from __future__ import annotations

import re

from quizlake.plans.views import VIEW_SQL

# --- fixed values, stated again so that a wrong one in the library shows --------------
# White space as the UI language and the text worker see it; RE2 has no vertical tab in \s.
WEB = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
DOC = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NO_GLUE_AFTER = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "nor", "but", "is",
    "are", "was", "were", "be", "been", "as", "if", "so", "no", "do", "we", "he", "she", "it",
    "us", "am", "by", "from", "with",
)
NO_GLUE_BEFORE = (
    "and", "or", "but", "which", "who", "whom", "whose", "that", "this", "these", "those",
    "when", "where", "why", "how", "if", "then", "because", "although", "while", "the", "in",
    "on", "at", "of", "for", "from", "with", "by", "as", "is", "are", "was", "were", "be",
    "been", "being", "has", "have", "had", "not", "no", "can", "may", "will", "would", "could",
    "should",
)
# --------------------------------------------------------------------------------------


def _trim(expr: str, space: str) -> str:
    return f"regexp_replace({expr}, '^{space}+|{space}+$', '', 'g')"


def _norm_ocr(expr: str) -> str:
    squeezed = f"regexp_replace(lower({expr}), '{WEB}+', ' ', 'g')"
    cleaned = rf"regexp_replace({squeezed}, '[^\p{{L}}\p{{N}} ?.:();-]', ' ', 'g')"
    return f"trim(regexp_replace({cleaned}, ' +', ' ', 'g'))"


def _freq_key(expr: str) -> str:
    squeezed = f"regexp_replace(lower({expr}), '{WEB}+', ' ', 'g')"
    return rf"substring(trim(regexp_replace({squeezed}, '[^\p{{L}}\p{{N}} ]+', '', 'g')), 1, 200)"


def _dedupe_key(expr: str) -> str:
    squeezed = f"regexp_replace(lower({expr}), '{DOC}+', ' ', 'g')"
    cleaned = rf"regexp_replace({squeezed}, '[^\p{{L}}\p{{N}}_ ?.:();%/\-]', ' ', 'g')"
    return f"trim(regexp_replace({cleaned}, ' +', ' ', 'g'))"


def _tokens(expr: str) -> str:
    cleaned = rf"trim(regexp_replace(lower({expr}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"list_filter(string_split({cleaned}, ' '), lambda t: t <> '')"


def _jaccard(a: str, b: str) -> str:
    inter = (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least("
        f"len(list_filter({a}, lambda x: x = w)), len(list_filter({b}, lambda y: y = w))))), 0)"
    )
    return (
        f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE ({inter})::DOUBLE / "
        f"(len({a}) + len({b}) - ({inter})) END"
    )


_MEAN = "list_reduce(grid, lambda a, x: a + x) / 64"
_STD = f"sqrt(list_reduce(list_transform(grid, lambda x: (x - ({_MEAN})) * (x - ({_MEAN}))), lambda a, x: a + x) / 64)"

VIEWS = dict(VIEW_SQL)
VIEWS["v_features"] = f"""SELECT job_id, frame_idx, grid, grid IS NOT NULL AS decoded,
 coalesce(sd <= 9 OR (mean <= 22 AND sd <= 11), false) AS blank,
 list_transform(grid, lambda x: CASE WHEN x >= mean THEN 1 ELSE 0 END) AS bits,
 row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS rn
 FROM (SELECT *, {_MEAN} AS mean, {_STD} AS sd FROM v_grids)"""
VIEWS["v_latest"] = "SELECT * FROM v_jobs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY version DESC) = 1"
VIEWS["v_mcq_lines"] = rf"""SELECT *, regexp_replace(raw0, '{DOC}+$', '') AS raw, {_trim('raw0', DOC)} AS body FROM (
 SELECT job_id, frame_idx, name, greatest(0, least(1, ocr_confidence / 100)) AS confidence, i - 1 AS line_no, parts[i] AS raw0
 FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT *, string_split(ocr_text, chr(10)) AS parts FROM v_mcq)))"""
VIEWS["v_classified"] = r"""SELECT *, body = '' AS blank,
 regexp_matches(body, '^\s*(?:Q(?:uestion)?\s*)?\d+\s*[).:]', 'i') AS stem_label,
 nullif(upper(CASE WHEN regexp_matches(body, '^\s*\(\s*[A-Ea-e]\s*\)\s*[).:]\s*.+$', 's')
   THEN regexp_extract(body, '^\s*\(\s*([A-Ea-e])\s*\)\s*[).:]\s*(.+)$', 1, 's')
   ELSE regexp_extract(body, '^\s*([A-E])\s*[).:]\s*(.+)$', 1, 's') END), '') AS letter,
 CASE WHEN regexp_matches(body, '^\s*\(\s*[A-Ea-e]\s*\)\s*[).:]\s*.+$', 's')
   THEN regexp_extract(body, '^\s*\(\s*([A-Ea-e])\s*\)\s*[).:]\s*(.+)$', 2, 's')
   ELSE regexp_extract(body, '^\s*([A-E])\s*[).:]\s*(.+)$', 2, 's') END AS option_text,
 regexp_matches(raw, '\(\s*[A-Da-d]\s*\)') AND length(raw) - length(replace(raw, '(', '')) >= 2 AS inline_mark
 FROM v_mcq_lines"""
VIEWS["v_segments"] = rf"""SELECT *, min(CASE WHEN NOT blank AND (stem_label OR block = 0 OR closed)
   AND len(list_distinct(list_transform(pairs, lambda p: p.k))) >= 2 THEN line_no END)
   OVER (PARTITION BY job_id, frame_idx, paragraph) AS inline_line FROM (
 SELECT *, CASE WHEN inline_mark THEN list_filter(list_transform(range(1, len(marks) + 1),
   lambda i: {{'k': upper(marks[i]), 'v': {_trim('vals[i + 1]', DOC)}}}), lambda p: p.v <> '') END AS pairs,
  coalesce(count(DISTINCT letter) OVER (PARTITION BY job_id, frame_idx, paragraph, block ORDER BY line_no
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 4 AS closed FROM (
  SELECT *, regexp_extract_all(chunk, '\(\s*([A-Da-d])\s*\)', 1) AS marks,
   regexp_split_to_array(chunk, '\(\s*[A-Da-d]\s*\)') AS vals,
   sum(stem_label::INT) OVER (PARTITION BY job_id, frame_idx, paragraph ORDER BY line_no) AS block FROM (
   SELECT *, concat_ws(' ', raw, lead(raw, 1) OVER w, lead(raw, 2) OVER w, lead(raw, 3) OVER w) AS chunk,
    sum(blank::INT) OVER w AS paragraph
   FROM v_classified WINDOW w AS (PARTITION BY job_id, frame_idx ORDER BY line_no))))"""
_LETTERS = "ABCDE"
_OPTS = ", ".join(f"CASE WHEN o{x} IS NOT NULL THEN concat('{x}:', {_trim(f'o{x}', WEB)}) END" for x in _LETTERS)
VIEWS["v_drafts"] = rf"""SELECT *, array_to_string(list_filter([{_OPTS}], lambda x: x IS NOT NULL), '|') AS options FROM (
 WITH blocks AS (
  SELECT job_id, frame_idx, min(line_no) AS line_no, min(name) AS name, min(confidence) AS confidence, 'block' AS kind,
   {_trim("string_agg(body, chr(10) ORDER BY line_no) FILTER (letter IS NULL OR stem_label)", DOC)} AS stem,
   {', '.join(f"arg_max({_trim('option_text', DOC)}, line_no) FILTER (letter = '{x}' AND NOT stem_label) AS o{x}" for x in _LETTERS)}
  FROM v_segments WHERE NOT blank AND block >= 1 AND NOT closed AND (inline_line IS NULL OR line_no < inline_line)
  GROUP BY job_id, frame_idx, paragraph, block
  HAVING count(DISTINCT letter) FILTER (NOT stem_label) >= 2),
 inlines AS (
  SELECT job_id, frame_idx, line_no, name, confidence, 'inline' AS kind, '(inline options)' AS stem,
   {', '.join(f"list_filter(pairs, lambda p: p.k = '{x}')[-1].v AS o{x}" for x in 'ABCD')}, CAST(NULL AS VARCHAR) AS oE
  FROM v_segments WHERE line_no = inline_line),
 found AS (SELECT * FROM blocks WHERE length(stem) >= 4 UNION ALL SELECT * FROM inlines),
 whole AS (SELECT job_id, frame_idx, name, min(confidence) AS confidence, string_agg(raw, chr(10) ORDER BY line_no) AS blob
  FROM v_mcq_lines GROUP BY ALL)
 SELECT * FROM found UNION ALL
 SELECT job_id, frame_idx, 0, name, confidence * 0.7::DOUBLE, 'blob', substring(blob, 1, 2000), NULL, NULL, NULL, NULL, NULL
 FROM whole WHERE (contains(upper(blob), '(A)')::INT + contains(upper(blob), '(B)')::INT
  + contains(upper(blob), '(C)')::INT + contains(upper(blob), '(D)')::INT) >= 3
  AND NOT EXISTS (SELECT 1 FROM found f WHERE f.job_id = whole.job_id AND f.frame_idx = whole.frame_idx))"""
VIEWS["v_bank"] = """SELECT *, concat('q', q_idx) AS id FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx, line_no) AS q_idx FROM v_drafts)"""
_HASH = (
    rf"sha256(concat(lower(regexp_replace({_trim('stem', WEB)}, '{WEB}+', ' ', 'g')), '::', options))"
)
_EDGE = r"\b"
_BREAK = lambda e: (
    rf"(regexp_matches({_trim(e, WEB)}, '\p{{L}}{{4,}}{WEB}+\p{{Ll}}{{1,2}}(?:{WEB}|[?.!,;:]|$)') OR "
    rf"regexp_matches({_trim(e, WEB)}, '{_EDGE}\p{{Lu}}\p{{Ll}}{{2,}}{WEB}+\p{{Ll}}{{2,4}}{_EDGE}'))"
)
_ANY_BREAK = "(" + " OR ".join(_BREAK(f"coalesce({c}, '')") for c in ("stem", "oA", "oB", "oC", "oD")) + ")"
_CLEAN = (
    f"(length({_trim('stem', WEB)}) >= 12 AND NOT contains(stem, chr(65533)) AND "
    + " AND ".join(
        f"{_trim(f'''coalesce({c}, '')''', WEB)} <> '' AND NOT contains(coalesce({c}, ''), chr(65533))"
        for c in ("oA", "oB", "oC", "oD")
    )
    + rf" AND len(regexp_extract_all({_trim('stem', WEB)}, '[\p{{L}}\p{{N}}]'))::DOUBLE / greatest(1, length({_trim('stem', WEB)})) >= 0.45)"
)
_NEED = lambda t: f"({_ANY_BREAK} OR NOT (confidence >= {t} AND {_CLEAN}))"
VIEWS["v_cache"] = f"SELECT DISTINCT job_id, {_HASH} AS content_hash FROM v_bank WHERE length(stem) % 2 = 0"


def _batches(threshold: str) -> str:
    """The first batch of a job that holds a question calls for it; later ones hit."""
    return f"""SELECT *, CASE WHEN NOT cache_hit THEN
  row_number() OVER (PARTITION BY job_id, batch_no, cache_hit ORDER BY pos) - 1 END AS call_pos FROM (
 SELECT *, known OR batch_no > first AS cache_hit FROM (
  SELECT b.*, c.content_hash IS NOT NULL AS known, min(batch_no) OVER (PARTITION BY b.job_id, b.h) AS first FROM (
   SELECT *, i // 25 AS batch_no, i % 25 AS pos FROM (
    SELECT *, {_HASH} AS h, row_number() OVER (PARTITION BY job_id ORDER BY q_idx) - 1 AS i FROM v_bank WHERE {_NEED(threshold)})) b
  LEFT JOIN v_cache c ON c.content_hash = b.h AND c.job_id = b.job_id))"""


VIEWS["v_batches"] = _batches("0.87")
VIEWS["v_exam_batches"] = _batches("0.93")
VIEWS["v_all_batches"] = "SELECT *, (q_idx - 1) // 25 AS batch_no, (q_idx - 1) % 25 AS pos, (q_idx - 1) % 25 AS call_pos FROM v_bank"


def _replies(batches: str, one: str | None) -> str:
    """Canned replies as the catalogue builds them."""
    if one is None:
        body = """concat('{"title":"Part ', batch_no, '","html":"<p>n</p>"}')"""
        short = "'null'"
    else:
        body = f"concat('[', string_agg({one}, ',' ORDER BY call_pos), ']')"
        short = "'[]'"
    return f"""SELECT job_id, batch_no, count(*) AS n, CASE batch_no % 4 WHEN 0 THEN {body}
 WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```') WHEN 2 THEN {short} END AS reply
 FROM {batches} WHERE call_pos IS NOT NULL GROUP BY job_id, batch_no"""


VIEWS["v_fix_replies"] = _replies(
    "v_batches", """concat('{"id":"', id, '","stem":"fixed ', id, '","options":{"A":"one","B":2}}')"""
)
VIEWS["v_exam_replies"] = _replies(
    "v_exam_batches", """concat('{"id":"', id, '","stem":"fixed ', id, '","options":{"A":"one","B":2}}')"""
)
VIEWS["v_key_replies"] = _replies("v_all_batches", """concat('{"id":"', id, '","letter":" b","rationale":"see notes"}')""")
VIEWS["v_topic_replies"] = _replies(
    "v_all_batches", """concat('{"id":"', id, '","topics":[" Law ","",', substring(id, 2, 9), ',"b","c","d"]}')"""
)
VIEWS["v_note_replies"] = _replies("v_all_batches", None)


def _elements(replies: str) -> str:
    """Elements of accepted replies with their call position."""
    return rf"""SELECT job_id, batch_no, pos - 1 AS call_pos, arr[pos] AS e FROM (
 SELECT *, unnest(range(1, len(arr) + 1)) AS pos FROM (
  SELECT job_id, batch_no, n, CAST(body AS JSON[]) AS arr FROM (
   SELECT job_id, batch_no, n, trim(CASE WHEN contains(reply, '```') THEN regexp_extract(reply, '```(?:json)?\s*(.*?)```', 1, 'is')
    ELSE reply END, chr(10) || ' ') AS body FROM {replies} WHERE reply IS NOT NULL)
  WHERE json_valid(body) AND json_type(body) = 'ARRAY')
 WHERE len(arr) = n AND len(list_filter(arr, lambda x: json_type(x) <> 'OBJECT')) = 0)"""


_FIX = f"""fixed AS (SELECT b.job_id, b.batch_no, b.q_idx, b.h, b.call_pos, json_extract_string(e, '$.id') AS id,
 json_extract_string(e, '$.stem') AS stem,
 concat('A:', json_extract_string(e, '$.options.A'), '|B:', json_extract_string(e, '$.options.B')) AS options
 FROM v_batches b JOIN ({_elements('v_fix_replies')}) r USING (job_id, batch_no, call_pos))"""

# What a run puts into the cache of its job: the last call for each question.
_RUN = """, run AS (SELECT c.job_id, c.h, arg_max(coalesce(f.stem, c.stem), c.call_pos) AS stem,
 arg_max(coalesce(f.options, c.options), c.call_pos) AS options
 FROM v_batches c LEFT JOIN fixed f USING (job_id, q_idx) WHERE NOT c.cache_hit GROUP BY c.job_id, c.h)"""

# Which views each view reads.
_ORDER = list(VIEWS)


def _needs(sql: str) -> list[str]:
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(VIEWS[name])
    return [name for name in _ORDER if name in wanted]


def _with(sql: str, extra: str = "", recursive: bool = False) -> str:
    ctes = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in _needs(sql + extra)]
    if extra:
        ctes.append(extra)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else ""
    return head + sql


def _fold(smart: bool) -> str:
    """Recursive fold over the frames of each job: last kept bits, grid and second."""
    dup = (
        "(r.k_bits IS NOT NULL AND list_sum(list_transform(range(1, 65), "
        "lambda i: CASE WHEN f.bits[i] <> r.k_bits[i] THEN 1 ELSE 0 END)) <= 10)"
    )
    ratio = (
        "CASE WHEN r.k_grid IS NULL THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(1, 65), "
        "lambda i: CASE WHEN abs(f.grid[i] - r.k_grid[i]) >= 12 THEN 1 ELSE 0 END))::DOUBLE / 64 END"
    )
    low = f"(f.frame_idx - r.k_sec < 2 OR ({ratio}) < 0.15)" if smart else "false"
    accept = f"(NOT f.decoded OR (NOT f.blank AND NOT {dup} AND NOT coalesce({low}, ({ratio}) < 0.15)))" if smart else (
        f"(NOT f.decoded OR (NOT f.blank AND NOT {dup}))"
    )
    return f"""folded AS (
 SELECT job_id, rn * 0 AS rn, CAST(NULL AS BIGINT) AS frame_idx, false AS accepted, false AS blank, false AS duplicate,
  0::DOUBLE AS change_ratio, CAST(NULL AS INTEGER[]) AS k_bits, CAST(NULL AS DOUBLE[]) AS k_grid, CAST(NULL AS BIGINT) AS k_sec,
  CAST(NULL AS INTEGER[]) AS bits FROM v_features WHERE rn = 1
 UNION ALL
 SELECT job_id, rn, frame_idx, acc, blank, dup, change_ratio, CASE WHEN acc THEN bits ELSE k_bits END,
  CASE WHEN acc THEN grid ELSE k_grid END, CASE WHEN acc THEN frame_idx ELSE k_sec END, bits FROM (
  SELECT f.job_id, f.rn, f.frame_idx, {accept} AS acc, f.blank, f.decoded AND NOT f.blank AND {dup} AS dup,
   CASE WHEN NOT f.decoded THEN 1.0::DOUBLE WHEN f.blank OR {dup} THEN 0.0::DOUBLE ELSE {ratio if smart else '1.0::DOUBLE'} END AS change_ratio,
   f.bits, f.grid, r.k_bits, r.k_grid, r.k_sec
  FROM folded r JOIN v_features f ON f.job_id = r.job_id AND f.rn = r.rn + 1)),
 decisions AS (SELECT * FROM folded WHERE rn > 0)"""


def _hex(bits: str) -> str:
    nibble = f"{bits}[4*i+1]*8 + {bits}[4*i+2]*4 + {bits}[4*i+3]*2 + {bits}[4*i+4]"
    return f"array_to_string(list_transform(range(0, 16), lambda i: substring('0123456789abcdef', {nibble} + 1, 1)), '')"


def _greedy(nodes: str, edges: str) -> str:
    """Sequential greedy clustering as recursion over each job's items. `nodes` gives
    (job_id, ord, rn, ok), `edges` the similar earlier items as (job_id, a, b)."""
    return f"""nodes AS MATERIALIZED ({nodes}), edges AS MATERIALIZED ({edges}),
 near AS MATERIALIZED (SELECT n.job_id, n.rn, n.ord, coalesce(list_sort(e.l), []) AS l FROM nodes n
  LEFT JOIN (SELECT job_id, b, list(a) AS l FROM edges GROUP BY job_id, b) e ON e.job_id = n.job_id AND e.b = n.ord),
 walk AS (
  SELECT job_id, 0::BIGINT AS rn, CAST(NULL AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS rep, CAST([] AS BIGINT[]) AS reps
  FROM nodes GROUP BY job_id
  UNION ALL
  SELECT job_id, rn, ord, coalesce(hit, ord), CASE WHEN hit IS NULL THEN list_append(reps, ord) ELSE reps END FROM (
   SELECT n.job_id, n.rn, n.ord, w.reps, list_min(list_intersect(n.l, w.reps)) AS hit
   FROM walk w JOIN near n ON n.job_id = w.job_id AND n.rn = w.rn + 1)),
 grouped AS (SELECT job_id, ord, rep FROM walk WHERE rn > 0)"""


# Letters outside ASCII map one to one to capitals and signs that normal forms lack, so a
# byte-wise edit distance counts characters.
_WIDE = "".join(chr(c) for c in range(0xDF, 0x100)) + "ışğœ"
_NARROW = "".join(chr(c) for c in range(33, 127) if chr(c).isupper() or chr(c) in "!\"#$%&*+,/<=>@[]^_{|}~")
def _narrow(expr: str) -> str:
    wide = _WIDE[: len(_NARROW)]
    narrow = _NARROW[: len(_WIDE)]
    return f"translate({expr}, '{wide}', '{narrow}')"


# How often each letter and sign occurs: two forms share no more characters than these allow,
# so most pairs need no full distance.
_LETTER_COUNTS = "[" + ", ".join(f"len(form) - len(replace(form, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz .") + "]"
_FORMS = f"""plain AS MATERIALIZED (SELECT job_id, frame_idx AS ord, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS rn,
 {_narrow(_norm_ocr("coalesce(ocr_text, '')"))} AS form FROM v_frames),
 grams AS MATERIALIZED (SELECT job_id, ord, list(concat(g, k)) AS grams FROM (
  SELECT job_id, ord, g, row_number() OVER (PARTITION BY job_id, ord, g) AS k FROM (
   SELECT job_id, ord, unnest(list_transform(range(1, length(form) - 4), lambda i: substring(form, i, 6))) AS g FROM plain))
  GROUP BY job_id, ord),
 forms AS MATERIALIZED (SELECT plain.*, {_LETTER_COUNTS} AS counts, length(form) AS n, grams FROM plain LEFT JOIN grams USING (job_id, ord))"""
_EDIT = _FORMS + ", " + _greedy(
    "SELECT job_id, ord, rn FROM forms",
    """SELECT job_id, a, b FROM (SELECT x.job_id, x.ord AS a, y.ord AS b, x.form AS s, y.form AS t, greatest(x.n, y.n) AS n,
  x.grams AS g, y.grams AS h FROM forms x JOIN forms y ON x.job_id = y.job_id AND x.ord < y.ord
  AND length(x.form) >= 4 AND length(y.form) >= 4
  AND least(x.n, y.n) >= 0.88 * greatest(x.n, y.n) - 1
  AND list_sum(list_transform(list_zip(x.counts, y.counts), lambda z: least(z[1], z[2])))
   + least(x.n - list_sum(x.counts), y.n - list_sum(y.counts)) >= 0.88 * greatest(x.n, y.n) - 1)
  WHERE CASE WHEN s = t THEN true WHEN coalesce(len(list_intersect(g, h)), 0) < n - 5 - 6 * floor(0.12 * n + 1e-9) THEN false
   ELSE 1 - levenshtein(s, t)::DOUBLE / n >= 0.88 END""",
)
_LINE_ITEMS = f"""items AS MATERIALIZED (SELECT job_id, frame_idx * 16777216 + line_no AS ord, frame_idx, line_no,
 row_number() OVER (PARTITION BY job_id ORDER BY frame_idx, line_no) AS rn, {_trim('line', WEB)} AS t, {_tokens(_trim('line', WEB))} AS tok FROM v_lines),
 able AS MATERIALIZED (SELECT *, len(tok) AS n FROM items WHERE length(t) >= 8),
 occ AS MATERIALIZED (SELECT job_id, ord, n, word, row_number() OVER (PARTITION BY job_id, ord, word) AS k FROM (
  SELECT job_id, ord, n, t, unnest(tok) AS word FROM able)),
 marked AS MATERIALIZED (SELECT DISTINCT job_id, ord FROM able WHERE t LIKE '\\_\\_%' ESCAPE '\\')"""
_JACCARD = _LINE_ITEMS + ", " + _greedy(
    "SELECT job_id, ord, rn FROM items",
    """SELECT * FROM (SELECT x.job_id, x.ord AS a, y.ord AS b FROM occ x JOIN occ y ON x.job_id = y.job_id AND x.word = y.word
   AND x.k = y.k AND x.ord < y.ord AND least(x.n, y.n) >= 0.91 * greatest(x.n, y.n)
   GROUP BY x.job_id, x.ord, y.ord, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.91
  UNION ALL SELECT x.job_id, x.ord, y.ord FROM able x JOIN able y ON x.job_id = y.job_id AND x.ord < y.ord AND x.n = 0 AND y.n = 0)
  WHERE (job_id, a) NOT IN (SELECT (job_id, ord) FROM marked)""",
)
_TOP = rf"""stems AS (SELECT job_id, stem, count(*) AS count, arg_min(name, o) AS sample_frame, min(o) AS o FROM (
 SELECT job_id, name, o, {_freq_key('raw')} AS stem FROM (
  SELECT job_id, name, frame_idx * 16777216 + i AS o, {_trim(f"CASE WHEN regexp_matches(line, '^{WEB}*[0-9]+[.)]{WEB}+[^\r\n]') THEN regexp_extract(line, '^{WEB}*[0-9]+[.)]{WEB}+(.+)', 1) ELSE line END", WEB)} AS raw FROM (
   SELECT job_id, name, frame_idx, i, parts[i] AS line FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
     SELECT job_id, name, frame_idx, regexp_split_to_array(t, '\n+') AS parts FROM (
      SELECT *, {_trim('ocr_text', WEB)} AS t FROM v_frames)
     WHERE length(t) >= 12 AND regexp_matches(t, 'what|which|why|how|select|choose|assertion|reason|fill in|true|false', 'i')))))
  WHERE length(raw) >= 15) WHERE length(stem) >= 12 GROUP BY job_id, stem HAVING count(*) >= 2)"""

_CODE = """CASE WHEN regexp_matches(lower(m), 'forbidden|private|members-only|drm') THEN 'protected_content'
 WHEN contains(lower(m), 'not found') AND regexp_matches(lower(m), 'ffmpeg|yt-dlp') THEN 'binary_missing'
 WHEN regexp_matches(lower(m), 'permission|enoent|eacces') THEN 'path_permission'
 WHEN regexp_matches(lower(m), 'invalid|url') THEN 'validation'
 WHEN regexp_matches(lower(m), 'network|timed out|unable to download') THEN 'network' ELSE 'unknown' END"""
_TAGS = """tags AS (SELECT d.source AS job_id, d.doc_id, list_filter([CASE quality WHEN 1 THEN ' Clean Prose ' WHEN 0 THEN 'Rough draft' END,
 CASE WHEN toxic = 1 THEN 'Toxic Content' END], lambda t: t IS NOT NULL) AS topics FROM documents d LEFT JOIN labels USING (doc_id))"""
_KEPT = """saved AS (SELECT job_id, (skipped_blank + skipped_duplicate)::BIGINT AS dropped, coalesce(k, 0) AS kept FROM v_latest
 LEFT JOIN (SELECT job_id, count(*) AS k FROM v_logs GROUP BY 1) USING (job_id))"""


def _esc(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


def _items(joiner: str) -> str:
    parts = ", ".join(
        f"CASE WHEN o{x} IS NOT NULL THEN concat('<li><strong>{x}.</strong> ', {_esc(f'o{x}')}, '</li>') END" for x in _LETTERS
    )
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), {joiner})"


_PLAIN = "concat(" + ", ".join(f"CASE WHEN o{x} IS NOT NULL THEN concat('  ({x}) ', o{x}, chr(10)) ELSE '' END" for x in _LETTERS) + ")"

_HEAD_LINE = r"""(regexp_matches(l.body, '^\s*(?:Q(?:uestion)?\s*)?\d+\s*[).:]', 'i')
 OR regexp_matches(l.body, '^\s*\(\s*[A-Ea-e]\s*\)\s*[).:]\s*.+$', 's') OR regexp_matches(l.body, '^\s*[A-E]\s*[).:]\s*.+$', 's'))"""
_WORD_RUN = r"[\p{L}\p{N}_]+"
_GLUE = (
    rf"(NOT regexp_matches(l.tail, '^[a-z]{{1,2}}\.{DOC}+') AND regexp_matches(held, '[\p{{L}}\p{{N}}]$') "
    rf"AND regexp_matches(l.tail, '^\p{{Ll}}') AND length(regexp_extract(held, '({_WORD_RUN})$', 1)) < 6 "
    rf"AND lower(regexp_extract(held, '({_WORD_RUN})$', 1)) NOT IN ({', '.join(repr(w) for w in NO_GLUE_AFTER)}) "
    rf"AND lower(regexp_extract(l.tail, '^({_WORD_RUN})', 1)) NOT IN ({', '.join(repr(w) for w in NO_GLUE_BEFORE)}))"
)
_FLUSH = "CASE WHEN w.buf IS NULL THEN w.done ELSE list_append(w.done, w.buf) END"
# One step per line of a frame: the finished lines and the open buffer.
_WRAP = rf"""wrap_lines AS MATERIALIZED (SELECT job_id, frame_idx, i, len(parts) AS n, parts[i] AS raw,
 regexp_replace(parts[i], '^{DOC}+', '') AS tail, {_trim('parts[i]', DOC)} AS body FROM (
 SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT job_id, frame_idx, string_split(nfc_normalize(ocr_text), chr(10)) AS parts FROM v_mcq))),
 walk AS (
 SELECT job_id, frame_idx, 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS done, CAST(NULL AS VARCHAR) AS buf FROM v_mcq
 UNION ALL
 SELECT l.job_id, l.frame_idx, l.i,
  CASE WHEN l.body = '' THEN list_append({_FLUSH}, l.raw) WHEN w.buf IS NULL OR {_HEAD_LINE} THEN {_FLUSH}
   WHEN ends_with(held, '-') OR {_GLUE} THEN w.done ELSE {_FLUSH} END,
  CASE WHEN l.body = '' THEN NULL WHEN w.buf IS NULL OR {_HEAD_LINE} THEN l.raw
   WHEN ends_with(held, '-') THEN concat(held[:-2], l.tail) WHEN {_GLUE} THEN concat(held, l.tail) ELSE l.raw END
 FROM (SELECT *, regexp_replace(buf, '{DOC}+$', '') AS held FROM walk) w
 JOIN wrap_lines l ON l.job_id = w.job_id AND l.frame_idx = w.frame_idx AND l.i = w.i + 1)"""
_JSON_OPTS = ", ".join(f"CASE WHEN o{x} IS NOT NULL THEN concat('\"{x}\":', to_json(o{x})) END" for x in _LETTERS)

ORACLES: dict[str, str] = {
    "ocr_words_to_text": _with(rf"""SELECT job_id, frame_idx, coalesce(text, '') AS text,
 round(coalesce(mean, CASE WHEN coalesce(text, '') <> '' THEN 70 ELSE 0 END), 6) AS mean_confidence FROM (
 SELECT job_id, frame_idx, string_agg(word, ' ' ORDER BY word_no) FILTER (level = 5 AND conf >= 0) AS text,
  avg(conf) FILTER (level = 5 AND conf >= 0) AS mean FROM (
  SELECT job_id, frame_idx, word_no, word, CASE WHEN word_no % 9 = 8 THEN 4 ELSE 5 END AS level,
   (length(word) * 7 % 101 - CASE WHEN word_no % 11 = 10 THEN 200 ELSE 0 END)::DOUBLE AS conf FROM (
   SELECT job_id, frame_idx, i - 1 AS word_no, parts[i] AS word FROM (
    SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
     SELECT job_id, frame_idx, regexp_split_to_array(coalesce(ocr_text, ''), '[ \n]') AS parts FROM v_frames))))
 GROUP BY job_id, frame_idx)"""),
    "decode_jobs": _with("""SELECT job_id, version, CASE WHEN loc THEN 'local' ELSE 'remote' END AS kind,
 CASE WHEN loc THEN p END AS file_path, CASE WHEN NOT loc THEN concat('https://host/', version) END AS url,
 CASE WHEN NOT loc THEN coalesce(i, 5)::DOUBLE END AS interval_sec FROM (
 SELECT *, p IS NOT NULL AND coalesce(k, CASE WHEN p IS NOT NULL THEN 'local' ELSE 'remote' END) = 'local' AS loc FROM (
  SELECT job_id, version, CASE version % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' END AS k,
   CASE WHEN version % 2 = 0 THEN concat('/videos/', version, '.mp4') END AS p,
   CASE WHEN version % 5 <> 0 THEN skipped_blank END AS i FROM v_jobs))"""),
    "grid_stats": _with(f"SELECT job_id, frame_idx, round({_MEAN}, 6) AS mean, round({_STD}, 6) AS std FROM v_grids"),
    "blank_filter": _with("SELECT job_id, frame_idx, decoded, blank FROM v_features"),
    "average_hash": _with(f"SELECT job_id, frame_idx, {_hex('bits')} AS phash FROM v_features"),
    "hamming_pairs": _with("""SELECT job_id, frame_idx, list_sum(list_transform(range(1, 65),
 lambda i: CASE WHEN bits[i] <> b[i] THEN 1 ELSE 0 END))::INT AS distance FROM (
 SELECT *, lag(bits) OVER (PARTITION BY job_id ORDER BY frame_idx) AS b FROM v_features) WHERE bits IS NOT NULL AND b IS NOT NULL"""),
    "change_ratio_lag": _with("""SELECT job_id, frame_idx, round(list_sum(list_transform(range(1, 65),
 lambda i: CASE WHEN abs(grid[i] - b[i]) >= 12 THEN 1 ELSE 0 END))::DOUBLE / 64, 6) AS change_ratio FROM (
 SELECT *, lag(grid) OVER (PARTITION BY job_id ORDER BY frame_idx) AS b FROM v_grids) WHERE grid IS NOT NULL AND b IS NOT NULL"""),
    "dedupe_last_kept": _with("SELECT job_id, frame_idx, accepted, blank, duplicate FROM decisions", _fold(False), True),
    "smart_filter": _with(
        f"""SELECT job_id, frame_idx, accepted, blank, duplicate, round(change_ratio, 6) AS change_ratio,
 CASE WHEN bits IS NULL OR blank THEN '' ELSE {_hex('bits')} END AS phash FROM decisions""", _fold(True), True),
    "filter_counters": _with("""SELECT job_id, count(*) FILTER (accepted) AS kept, count(*) FILTER (blank) AS skipped_blank,
 count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT accepted AND NOT blank AND NOT duplicate) AS low_change,
 count(*) FILTER (NOT accepted AND NOT blank) AS skipped_duplicate FROM decisions GROUP BY job_id""", _fold(True), True),
    "accepted_manifest": _with("""SELECT job_id, frame_idx, n AS frame_no, printf('frame_%06d.png', n) AS name FROM (
 SELECT job_id, frame_idx, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) AS n FROM decisions WHERE accepted)""", _fold(True), True),
    "sample_interval": _with("""SELECT job_id, b AS bucket, arg_min(seq, (ts, seq)) AS seq, arg_min(stage, (ts, seq)) AS stage, count(*) AS in_bucket FROM (
 SELECT *, epoch_us(ts) // 3600000000 AS b FROM v_logs) GROUP BY job_id, b"""),
    "resolve_capture": _with("""SELECT job_id, version, preset, round(greatest(0.25, least(120, coalesce(ai, CASE WHEN long THEN least(120, pi * f) ELSE pi END)))::DOUBLE, 6) AS interval_sec,
 round(greatest(0, least(300, coalesce(ac, CASE WHEN long THEN least(300, pc * 1.1::DOUBLE) ELSE pc END)))::DOUBLE, 6) AS cooldown_sec, pt AS change_threshold FROM (
 SELECT *, ai IS NULL AND ac IS NULL AND d >= 600 AS long, CASE WHEN d > 3600 THEN 1.35::DOUBLE ELSE 1.15::DOUBLE END AS f,
  CASE preset WHEN 'fast_notes' THEN 3 WHEN 'mcq_hunter' THEN 0.5 WHEN 'exam_revision' THEN 2 ELSE 1 END::DOUBLE AS pi,
  CASE preset WHEN 'fast_notes' THEN 2.5 WHEN 'mcq_hunter' THEN 1 WHEN 'exam_revision' THEN 2.5 ELSE 2 END::DOUBLE AS pc,
  CASE preset WHEN 'fast_notes' THEN 0.22 WHEN 'mcq_hunter' THEN 0.1 WHEN 'exam_revision' THEN 0.18 ELSE 0.15 END::DOUBLE AS pt FROM (
  SELECT job_id, version, CASE version % 5 WHEN 0 THEN 'fast_notes' WHEN 1 THEN 'mcq_hunter' WHEN 3 THEN 'exam_revision' ELSE 'full_lecture' END AS preset,
   (version * 7 % 5000)::DOUBLE AS d, CASE WHEN version % 6 = 0 THEN skipped_blank::DOUBLE END AS ai,
   CASE WHEN version % 10 = 0 THEN (version % 400)::DOUBLE END AS ac FROM v_jobs))"""),
    "question_flags": _with(rf"""SELECT job_id, frame_idx, contains(t, '?') AS has_question_mark,
 regexp_matches(t, '\(\s*[A-Da-d]\s*\)') OR regexp_matches(t, '(?m)(?:^|\s)[A-Da-d]\s*[).]\s') AS mcq_style,
 regexp_matches(t, '(?:^|\s)(?:i{{1,3}}|iv|v|vi{{0,3}}|ix|x)\s*[).:]', 'i') AS roman_enumeration
 FROM (SELECT *, {_trim('ocr_text', WEB)} AS t FROM v_mcq)"""),
    "view_questions": _with(rf"""SELECT job_id, frame_idx, name FROM (SELECT *, {_trim('ocr_text', WEB)} AS t FROM v_mcq)
 WHERE t <> '' AND (contains(t, '?') OR regexp_matches(t, '\(\s*[A-Da-d]\s*\)') OR regexp_matches(t, '(?m)(?:^|\s)[A-Da-d]\s*[).]\s'))"""),
    "view_slides": _with("SELECT job_id, frame_idx, change_ratio FROM v_frames WHERE change_ratio >= 0.2"),
    "view_text_heavy": _with("SELECT job_id, frame_idx, name FROM v_frames WHERE length(ocr_text) > 120"),
    "text_signal": _with("SELECT job_id, coalesce(bool_or(length(ocr_text) > 0), false) AS has_text FROM v_frames GROUP BY job_id"),
    "usable_frames": _with(f"SELECT job_id, frame_idx, name FROM v_frames WHERE {_trim('ocr_text', WEB)} <> '' AND coalesce(include_in_pdf, true)"),
    "kept_frames": _with("SELECT job_id, frame_idx, name FROM v_frames WHERE coalesce(include_in_pdf, true)"),
    "best_frames": _with(rf"""SELECT job_id, frame_idx, round(score, 6) AS score FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, frame_idx) AS rk, count(*) OVER (PARTITION BY job_id) AS n FROM (
  SELECT job_id, frame_idx, CASE WHEN contains(t, '?') OR regexp_matches(t, '\(\s*[A-Da-d]\s*\)') OR regexp_matches({_trim('t', WEB)}, '(?m)(?:^|\s)[A-Da-d]\s*[).]\s')
    THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN coalesce(include_in_pdf, true) THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END
   + least(1.2::DOUBLE, length(t)::DOUBLE / 400.0::DOUBLE) + change_ratio AS score
  FROM (SELECT *, coalesce(ocr_text, '') AS t FROM v_frames)))
 WHERE rk <= greatest(1, ceil(n * 0.55::DOUBLE))"""),
    "weak_topic_bank": _with("""SELECT job_id, doc_id, array_to_string(topics, '|') AS topics FROM tags
 WHERE len(list_filter(topics, lambda t: contains(lower(t), 'toxic'))) > 0""", _TAGS),
    "unsolved_questions": "SELECT doc_id, source AS job_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "structural_clean": _with(f"SELECT job_id, q_idx, {_CLEAN} AS clean FROM v_bank"),
    "wordbreak_artifacts": _with(f"SELECT job_id, q_idx, {_ANY_BREAK} AS word_break FROM v_bank"),
    "route_questions": _with(f"SELECT job_id, q_idx, {_NEED('0.87')} AS fast, {_NEED('0.93')} AS exam, false AS notes FROM v_bank"),
    "normalize_ocr": f"SELECT doc_id, {_norm_ocr('text')} AS norm FROM documents",
    "frequency_keys": _with(f"SELECT job_id, frame_idx, line_no, {_freq_key('line')} AS stem, {_dedupe_key('line')} AS norm FROM v_lines"),
    "content_hash": _with(f"SELECT job_id, q_idx, {_HASH} AS content_hash FROM v_bank"),
    "levenshtein_pairs": f"""SELECT job_id, turn, round(CASE WHEN f = b THEN 1.0::DOUBLE WHEN length(f) = 0 OR length(b) = 0 THEN 0.0::DOUBLE
 ELSE 1 - levenshtein(f, b)::DOUBLE / greatest(length(f), length(b)) END, 6) AS ratio FROM (
 SELECT *, lag(f) OVER (PARTITION BY job_id ORDER BY turn) AS b FROM (
  SELECT conv_id AS job_id, turn, {_narrow(_norm_ocr('text'))} AS f FROM conversations)) WHERE b IS NOT NULL""",
    "multiset_jaccard_pairs": _with(f"""SELECT job_id, frame_idx, line_no, round({_jaccard('t', 'b')}, 6) AS jaccard FROM (
 SELECT *, lag(t) OVER (PARTITION BY job_id, frame_idx ORDER BY line_no) AS b FROM (
  SELECT job_id, frame_idx, line_no, {_tokens('line')} AS t FROM v_lines)) WHERE b IS NOT NULL"""),
    "merge_wrapped_lines": _with(f"""SELECT w.job_id, w.frame_idx, array_to_string({_FLUSH}, chr(10)) AS merged
 FROM walk w JOIN (SELECT DISTINCT job_id, frame_idx, n FROM wrap_lines) z ON z.job_id = w.job_id AND z.frame_idx = w.frame_idx AND z.n = w.i""", _WRAP, True),
    "format_timestamp": _with("""SELECT job_id, frame_idx, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
 ELSE printf('%d:%02d', s // 60, s % 60) END AS clock FROM (SELECT job_id, frame_idx, floor(seconds * 61.5::DOUBLE)::BIGINT AS s FROM v_frames)"""),
    "url_host_path_key": "SELECT page_id, CASE WHEN page_id % 6 <= 3 THEN substring(md5(url), 1, 11) END AS video_id FROM pages",
    "escape_html": f"SELECT page_id, {_esc('html')} AS escaped, replace(replace(html, '&', '&amp;'), '<', '&lt;') AS minimal FROM pages",
    "topic_slugs": "SELECT page_id, substring(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 48) AS slug FROM pages",
    "classify_lines": _with("SELECT job_id, frame_idx, line_no, blank, stem_label, letter, inline_mark FROM v_classified"),
    "frame_text_stats": _with("""SELECT job_id, frame_idx, name, round(ocr_confidence, 4) AS mean_confidence, length(coalesce(ocr_text, ''))::INT AS char_count,
 greatest(0, least(1, ocr_confidence / 100)) AS confidence FROM v_frames"""),
    "numbered_questions": _with("SELECT job_id, q_idx, id, frame_idx, line_no FROM v_bank"),
    "dup_groups_edit": _with("""SELECT job_id, ord AS frame_idx, rep, dense_rank() OVER (PARTITION BY job_id ORDER BY rep) - 1 AS group_id FROM grouped""", _EDIT, True),
    "first_per_group": _with("SELECT job_id, ord AS frame_idx, printf('frame_%06d.png', ord) AS name FROM grouped WHERE ord = rep", _EDIT, True),
    "dup_group_sizes": _with("SELECT job_id, ord AS frame_idx, count(*) OVER (PARTITION BY job_id, rep) AS group_size FROM grouped", _EDIT, True),
    "collapse_jaccard": _with("""SELECT job_id, frame_idx, line_no, rep // 16777216 AS rep_frame, rep % 16777216 AS rep_line
 FROM grouped JOIN items USING (job_id, ord)""", _JACCARD, True),
    "top_stems": _with("SELECT job_id, stem, count, sample_frame FROM stems QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY count DESC, o) <= 12", _TOP),
    "topic_count": _with("""SELECT job_id, nullif(count(DISTINCT t), 0) AS topic_count FROM (SELECT job_id, lower(trim(unnest(CASE WHEN len(topics) = 0 THEN [NULL] ELSE topics END))) AS t FROM tags) GROUP BY job_id""", _TAGS),
    "topic_estimate": _with("""SELECT job_id, greatest(6, least(64, floor(6::DOUBLE + slides * 0.28::DOUBLE + coalesce(anchors, 0) * 1.4::DOUBLE + 0.5)))::BIGINT AS topic_estimate FROM (
 SELECT job_id, count(*) FILTER (change_ratio >= 0.18) AS slides FROM v_frames GROUP BY job_id)
 LEFT JOIN (SELECT job_id, least(8, count(*)) AS anchors FROM stems GROUP BY job_id) USING (job_id)""", _TOP),
    "time_saved": _with("SELECT job_id, dropped, kept, greatest(0, floor((dropped * 8 + kept * 3) / 60.0::DOUBLE + 0.5))::BIGINT AS minutes_saved FROM saved", _KEPT),
    "junk_percent": _with("""SELECT job_id, dropped, kept, coalesce(least(99, floor(dropped::DOUBLE / nullif(dropped + kept, 0) * 100 + 0.5)), 0)::BIGINT AS junk_percent FROM saved""", _KEPT),
    "token_counts": f"""SELECT key, token, count(*) AS n FROM (SELECT concat(conv_id, ':', turn) AS key, unnest({_tokens('text')}) AS token
 FROM conversations) GROUP BY key, token""",
    "upsert_latest": _with("SELECT * FROM v_latest"),
    "artifact_upsert": _with("""SELECT job_id, stage AS kind, concat('/f/', seq % 17) AS path, max(seq) AS seq, arg_max(value, seq) AS value FROM v_logs GROUP BY 1, 2, 3"""),
    "retain_newest_jobs": _with("""SELECT job_id, seq, stage FROM v_logs WHERE job_id IN (SELECT job_id FROM v_latest ORDER BY updated_at DESC, job_id LIMIT 20)"""),
    "delete_cascade": _with("SELECT job_id, seq FROM v_logs WHERE job_id NOT IN (SELECT job_id FROM v_latest WHERE state = 'failed')"),
    "replace_children": _with("""SELECT job_id, seq, stage FROM v_logs WHERE job_id NOT IN (SELECT job_id FROM v_latest WHERE state IN ('done', 'queued'))
 UNION ALL SELECT job_id, version, 'fresh' FROM v_latest WHERE state = 'done'"""),
    "log_retention": _with("SELECT job_id, seq, stage FROM v_logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 1000"),
    "log_tail": _with("SELECT job_id, seq, stage FROM v_logs QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) <= 40"),
    "patch_columns": _with("""SELECT job_id, CASE WHEN m > 150 THEN 'paused' ELSE state END AS state, CASE WHEN m > 250 THEN NULL ELSE error_message END AS error_message
 FROM v_latest LEFT JOIN (SELECT job_id, max(value) AS m FROM v_logs GROUP BY 1) USING (job_id)"""),
    "paginate_export": _with("""SELECT job_id, frame_idx, page, part, ceil(count(*) OVER (PARTITION BY job_id, part) / 2.0)::BIGINT AS pages_in_part FROM (
 SELECT job_id, frame_idx, i // 2 AS page, i // 14 AS part FROM (SELECT job_id, frame_idx, row_number() OVER (PARTITION BY job_id ORDER BY frame_idx) - 1 AS i FROM v_frames))"""),
    "bank_plain_text": _with(f"""SELECT job_id, (q_idx - 1) // 200 AS part, string_agg(concat('Question ', q_idx, chr(10), stem, chr(10), {_PLAIN}), chr(10) ORDER BY q_idx) AS body
 FROM v_bank GROUP BY job_id, (q_idx - 1) // 200"""),
    "bank_html": _with(f"""SELECT job_id, q_idx, concat('<article class="q">', chr(10), '  <h2>', id, '</h2>', chr(10), '  <p class="stem">', {_esc('stem')}, '</p>', chr(10),
 '  <ol class="opts">', {_items('chr(10)')}, '</ol>', chr(10), '</article>') AS html FROM v_bank"""),
    "shuffled_bank": _with(f"""SELECT job_id, q_idx, exam_no, concat('<article class="q"><h2>Question ', exam_no, '</h2><p>', {_esc('stem')}, '</p><ol type="A" class="opts">', {_items("''")}, '</ol></article>') AS html FROM (
 SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY md5(concat('exam:', job_id, ':', q_idx)), q_idx) AS exam_no FROM v_bank)"""),
    "job_with_children": _with("""SELECT job_id, state, run, frames, logs FROM v_latest LEFT JOIN (SELECT * FROM (
 SELECT job_id, i // 20 AS run, string_agg(printf('frame_%06d.png@%d', seq, seq % 50), ',' ORDER BY seq % 50, seq) AS frames FROM (
  SELECT job_id, seq, row_number() OVER (PARTITION BY job_id ORDER BY seq % 50, seq) - 1 AS i FROM v_logs) GROUP BY 1, 2)
 FULL JOIN (SELECT job_id, i // 20 AS run, string_agg(concat(seq, ':', stage), ',' ORDER BY seq) AS logs FROM (
  SELECT job_id, seq, stage, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS i FROM v_logs) GROUP BY 1, 2) USING (job_id, run)) USING (job_id)"""),
    "recent_jobs": _with("SELECT job_id, version, state FROM v_latest ORDER BY updated_at DESC, job_id LIMIT 10"),
    "recover_interrupted": _with("""SELECT job_id, version, 'failed' AS state, 'Interrupted' AS error_message FROM (
 SELECT * FROM v_latest ORDER BY updated_at DESC, job_id LIMIT 50) WHERE state NOT IN ('done', 'failed', 'fallback_required', 'cancelled')"""),
    "finished_jobs": _with("SELECT job_id, version FROM v_jobs WHERE state = 'done'"),
    "toggle_parity": _with("SELECT job_id, stage, count(*) AS toggles FROM v_logs GROUP BY 1, 2 HAVING count(*) % 2 = 1"),
    "enrichment_batches": _with("SELECT job_id, q_idx, batch_no, pos, cache_hit, call_pos FROM v_batches"),
    "cache_hits_misses": _with("SELECT job_id, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses FROM v_batches GROUP BY job_id"),
    "pack_requests": _with(f"""SELECT job_id, batch_no, count(*) AS n, concat('[', string_agg(concat('{{"id":', to_json(id), ',"stem":', to_json(stem),
 ',"options":{{', array_to_string(list_filter([{_JSON_OPTS}], lambda x: x IS NOT NULL), ','), '}}}}'), ',' ORDER BY call_pos), ']') AS request
 FROM v_batches WHERE call_pos IS NOT NULL GROUP BY job_id, batch_no"""),
    "validate_replies": _with("SELECT job_id, batch_no, q_idx, id, stem, options FROM fixed", _FIX),
    "polished_bank": _with("""SELECT b.job_id, b.q_idx, CASE WHEN h.known THEN 'cached' WHEN h.cache_hit THEN r.stem ELSE coalesce(f.stem, b.stem) END AS stem,
 CASE WHEN h.known THEN 'A:hit' WHEN h.cache_hit THEN r.options ELSE coalesce(f.options, b.options) END AS options
FROM v_bank b LEFT JOIN v_batches h USING (job_id, q_idx) LEFT JOIN fixed f USING (job_id, q_idx)
LEFT JOIN run r ON r.job_id = b.job_id AND r.h = h.h""", _FIX + _RUN),
    "polish_cache": _with("""SELECT job_id, h AS content_hash, stem, options FROM run
UNION ALL SELECT job_id, content_hash, 'cached', 'A:hit' FROM v_cache""", _FIX + _RUN),
    "finalize_calls": _with(f"""SELECT job_id, (coalesce(calls, 0) + ceil(n / 25.0))::BIGINT AS calls, coalesce(hits, 0) AS cache_hits, skipped FROM (
 SELECT job_id, count(*) AS n, count(*) FILTER (NOT {_NEED('0.93')}) AS skipped FROM v_bank GROUP BY job_id)
LEFT JOIN (SELECT job_id, count(*) FILTER (cache_hit) AS hits FROM v_exam_batches GROUP BY 1) USING (job_id)
LEFT JOIN (SELECT job_id, count(DISTINCT batch_no) AS calls FROM ({_elements('v_exam_replies')}) GROUP BY 1) USING (job_id)"""),
    "enrichment_counters": _with(f"""SELECT job_id, coalesce(calls, 0) AS calls, coalesce(hits, 0) AS cache_hits, skipped FROM (
 SELECT job_id, count(*) FILTER (NOT {_NEED('0.87')}) AS skipped FROM v_bank GROUP BY job_id)
 LEFT JOIN (SELECT job_id, count(*) FILTER (cache_hit) AS hits FROM v_batches GROUP BY 1) USING (job_id)
 LEFT JOIN (SELECT job_id, count(DISTINCT batch_no) AS calls FROM fixed GROUP BY 1) USING (job_id)""", _FIX),
    "answer_key": _with(f"""SELECT job_id, q_idx, coalesce(json_extract_string(e, '$.id'), id) AS id, coalesce(upper(trim(json_extract_string(e, '$.letter'))), '?') AS letter,
 coalesce(json_extract_string(e, '$.rationale'), 'DeepSeek unavailable — verify manually.') AS rationale
 FROM v_all_batches LEFT JOIN ({_elements('v_key_replies')}) USING (job_id, batch_no, call_pos)"""),
    "topic_tags": _with(f"""SELECT job_id, q_idx, CASE WHEN e IS NOT NULL THEN array_to_string(list_filter(list_transform(
 list_filter(CAST(e->'$.topics' AS JSON[]), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(x->>'$')), lambda s: s <> '')[1:3], '|') END AS topics
 FROM v_all_batches LEFT JOIN ({_elements('v_topic_replies')}) USING (job_id, batch_no, call_pos)"""),
    "notes_sections": _with("""SELECT b.job_id, b.batch_no, CASE WHEN ok THEN concat('Part ', b.batch_no) ELSE concat('Batch ', b.batch_no + 1) END AS title,
 CASE WHEN ok THEN '<p>n</p>' ELSE concat('<section><p>Section unavailable (offline or timeout). Use raw MCQ export.</p><pre>',
  replace(replace(stems, '&', '&amp;'), '<', '&lt;'), '</pre></section>') END AS html FROM (
 SELECT job_id, batch_no, string_agg(stem, chr(10) || '---' || chr(10) ORDER BY pos) AS stems FROM v_all_batches GROUP BY 1, 2) b
 LEFT JOIN (SELECT job_id, batch_no, reply IS NOT NULL AND reply <> 'null' AS ok FROM v_note_replies) r USING (job_id, batch_no)"""),
    "revision_fragments": _with("""SELECT job_id, batch_no, CASE WHEN reply IS NOT NULL AND reply <> 'null' THEN '<p>n</p>'
 ELSE concat('<section><h2>Batch ', batch_no + 1, '</h2><p>Revision fragment unavailable.</p></section>') END AS html FROM v_note_replies"""),
    "merge_with_fallback": """SELECT a.conv_id, a.turn, md5(coalesce(r.reply, a.text)) AS merged, r.reply IS NOT NULL AS answered FROM conversations a
 LEFT JOIN (SELECT conv_id, turn - 1 AS turn, min(text) AS reply FROM conversations WHERE role = 'assistant' GROUP BY 1, 2) r
 ON r.conv_id = a.conv_id AND r.turn = a.turn WHERE a.role = 'user'""",
    "classify_errors": _with(f"""SELECT job_id, version, code, CASE WHEN regexp_matches(lower(m), 'worker exited|exited with code') THEN 'helper_stopped'
 WHEN regexp_matches(lower(m), 'tesseract|ocr engine') THEN 'recognition_failed' WHEN regexp_matches(lower(m), 'paddle|python') THEN 'engine_not_started'
 WHEN code IN ('binary_missing', 'path_permission', 'network') THEN code ELSE 'other' END AS category FROM (
 SELECT job_id, version, m, {_CODE} AS code FROM (SELECT *, error_message AS m FROM v_jobs) WHERE m IS NOT NULL)"""),
    "transient_errors": _with("""SELECT job_id, version,
 regexp_matches(lower(error_message), 'worker exited|exited with code|econnreset|spawn enoent|timed out|epipe') AS transient_pipeline,
 regexp_matches(lower(error_message), 'econnreset|timed out|timeout|aborted|429|503|502|mcq ocr worker finished without|worker thread exited') AS transient_model
 FROM v_jobs WHERE error_message IS NOT NULL"""),
    "illegal_transitions": _with("""SELECT job_id, version, state, before FROM (
 SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY version) AS before FROM v_jobs)
 WHERE before <> state AND (before, state) NOT IN (('queued', 'probing'), ('probing', 'extracting'), ('probing', 'failed'), ('extracting', 'failed'))"""),
    "phase_counts": _with("""SELECT job_id, CASE stage WHEN 'click' THEN 'ai' WHEN 'signup' THEN 'scanning' WHEN 'error' THEN 'detecting' ELSE 'extracting' END AS phase,
 count(*) AS events FROM v_logs GROUP BY 1, 2"""),
    "throttle_latest": _with("""SELECT job_id, bucket, count(*) AS events, arg_max(seq, (ts, seq)) AS seq, arg_max(stage, (ts, seq)) AS stage FROM (
 SELECT *, epoch_us(ts) // 3600000000 AS bucket FROM v_logs) GROUP BY 1, 2"""),
    "run_outcomes": _with("""SELECT job_id AS run_id, min(seq) AS seq, arg_min(CASE stage WHEN 'purchase' THEN 'done' ELSE 'error' END, seq) AS outcome
 FROM v_logs WHERE stage IN ('purchase', 'error') GROUP BY 1"""),
    "decoder_progress": _with("""SELECT job_id, seq, CASE WHEN stage <> 'error' THEN (seq % 3 * 3600 + seq % 60 * 60 + seq % 59)::DOUBLE + 0.5 END AS seconds
 FROM v_logs WHERE stage NOT IN ('view', 'click')"""),
}
for _kind, _name in (("block", "extract_questions"), ("inline", "extract_inline_options"), ("blob", "blob_fallback")):
    ORACLES[_name] = _with(
        f"SELECT job_id, frame_idx, line_no, stem, options, round(confidence, 6) AS confidence FROM v_drafts WHERE kind = '{_kind}'"
    )
