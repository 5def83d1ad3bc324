"""The queries in DuckDB's SQL, from the same fixed values, written independently of the DataFrame code."""

from __future__ import annotations

from ..functions import recipes as R
from ..functions import vocabulary as V
from ..functions.text import LEXICAL_PATTERN
from ..sources.overlay import BUNDLES, EXTENSIONS, SNIPPETS


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def hits(x: str, markers) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(m)}) AS INT)" for m in markers) + ")"


def has(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(m)})" for m in markers) + ")"


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


LANG = "CASE " + " ".join(f"WHEN ext IN ({', '.join(q(e) for e in es)}) THEN '{n}'" for n, es in V.LANGUAGES.items()) + " ELSE 'unknown' END"

CODE = rf"""code AS (
  SELECT source AS repo, CASE WHEN doc_id % 40 = 7 THEN source || '/d' || doc_id || '/README.md' ELSE source || '/src/f' || doc_id || '.' || {array(EXTENSIONS)}[doc_id % 8 + 1] END AS path,
         {array(EXTENSIONS)}[doc_id % 8 + 1] AS ext, {array(SNIPPETS)}[(doc_id // 8) % 16 + 1] || chr(10) || coalesce(text, '') AS content FROM documents),
split AS (SELECT *, string_split_regex(content, '\r?\n') AS ls FROM code),
f AS (SELECT repo, path, ext, {LANG} AS lang, content, {low("content")} AS lc, CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END AS ls,
      parse_filename(path) AS name FROM split)"""
#: Lines as rows: no from 1, raw and trimmed.
LINES = CODE + rf""",
l AS (SELECT repo, path, ext, lang, name, no, raw, {trim("raw")} AS t FROM (SELECT repo, path, ext, lang, name, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM f))"""
COMMENT = "(starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR (starts_with(t, '#') AND NOT starts_with(t, '#[') AND NOT starts_with(t, '#![')))"
BODY = trim("regexp_replace(t, '^/*\\**#*', '')")

LEXICAL = f"""WITH {LINES},
m AS (SELECT repo, path, regexp_extract_all(lc, {q(LEXICAL_PATTERN)}) AS g FROM f WHERE lang <> 'unknown'),
r AS (SELECT repo, path, min(no) AS a, max(no) AS b FROM l WHERE regexp_matches({low("raw")}, {q(LEXICAL_PATTERN)}) GROUP BY ALL)
SELECT repo, path, CAST(len(g) AS BIGINT) AS matches, CAST(len(list_distinct(g)) AS BIGINT) AS terms, CAST(a AS BIGINT) AS first_line, CAST(b AS BIGINT) AS last_line FROM m LEFT JOIN r USING (repo, path)"""

def _comments(digits: int) -> str:
    return f"""WITH {LINES},
c AS (SELECT repo, path, count(*) FILTER (t <> '') AS non_empty, count(*) FILTER ({COMMENT}) AS comment_lines, count(*) FILTER ({COMMENT} AND {has(low("t"), V.TUTORIAL)}) AS tutorial FROM l WHERE lang <> 'unknown' GROUP BY ALL),
p AS (SELECT repo, path, max(n) AS most FROM (SELECT repo, path, array_to_string(string_split_regex({low(BODY)}, '\\s+')[1:3], ' ') AS s, count(*) AS n FROM l WHERE {COMMENT} AND {BODY} <> '' GROUP BY ALL) GROUP BY ALL)
SELECT repo, path, CAST(non_empty AS BIGINT) AS non_empty, CAST(comment_lines AS BIGINT) AS comment_lines, CAST(tutorial AS BIGINT) AS tutorial,
 round(CASE WHEN non_empty = 0 THEN 0 ELSE comment_lines / non_empty END, {digits}) AS density, round(CASE WHEN comment_lines = 0 THEN 0 ELSE coalesce(most, 0) / comment_lines END, {digits}) AS prefix_ratio
FROM c LEFT JOIN p USING (repo, path)"""


COMMENTS = _comments(6)


def simple(where: str, severity: str, confidence: str, metrics: str, more: str = "") -> str:
    return f"""WITH {CODE}, m AS (SELECT repo, path, {metrics} FROM f WHERE {more})
SELECT repo, path, CASE WHEN {severity} THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, greatest(0.0, {confidence})), 6) AS confidence FROM m WHERE {where}"""


HEADS = f"list_distinct(list_transform(list_filter(list_transform(ls, lambda x: {trim('x')}), lambda x: starts_with(x, '#')), lambda x: {low(trim(chr(114) + 'egexp_replace(x, ' + q('^#+') + ', ' + q('') + ')'))}))"
PROMPT = simple("h >= 2", "h >= 4", "h / 8", f"{hits('lc', V.PROMPT)} AS h", "ext IN ('md','txt','rst','adoc','rs','py','go','ts','tsx','js','jsx','cs','zig','cpp','toml','yaml','json')")
IDIOM = simple("x >= 3 AND n <= 2", "x >= 6", "0.7 * x / 8 + 0.3 * (2 - n) / 2", f"{hits('lc', V.FOREIGN)} AS x, {hits('lc', V.NATIVE)} AS n", "ext = 'rs'")
README = simple("s >= 5 AND p >= 2", "s >= 7 AND p >= 3", "0.7 * s / 9 + 0.3 * p / 6", f"len(list_intersect({HEADS}, {array(V.README_HEADINGS)})) AS s, {hits('lc', V.README_PHRASES)} AS p", "ext = 'md'")
LEXICAL_FINDINGS = f"""WITH {LINES}, m AS (SELECT repo, path, regexp_extract_all(lc, {q(LEXICAL_PATTERN)}) AS g FROM f WHERE lang <> 'unknown'),
r AS (SELECT repo, path, min(no) AS a, max(no) AS b FROM l WHERE regexp_matches({low("raw")}, {q(LEXICAL_PATTERN)}) GROUP BY ALL)
SELECT repo, path, CASE WHEN len(g) >= 8 THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, len(g) / 12 + len(list_distinct(g)) / 12), 6) AS confidence, CAST(a AS INT) AS line_start, CAST(b AS INT) AS line_end
FROM m JOIN r USING (repo, path) WHERE len(g) >= 4 AND len(list_distinct(g)) >= 3"""


def _comment_findings(digits: int, of: str) -> str:
    return f"""SELECT repo, path, CASE WHEN density > 0.6 AND tutorial > 3 THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, 0.5 * density + 0.3 * tutorial / 8 + 0.2 * prefix_ratio), {digits}) AS confidence
FROM ({of}) WHERE non_empty >= 12 AND density >= 0.45 AND (tutorial >= 3 OR prefix_ratio >= 0.65)"""


COMMENT_FINDINGS = _comment_findings(4, COMMENTS)


def _tests() -> str:
    names, asserts = [], []
    for lang, (pattern, start, inside, begins) in V.TEST_SHAPES.items():
        g = f"regexp_extract(t, {q(pattern)}, 1)"
        names.append(f"WHEN lang = '{lang}' AND starts_with({g}, {q(start)}) THEN nullif({g}, '')")
        begin = "".join(f" OR starts_with(t, {q(b)})" for b in begins)
        asserts.append(f"WHEN lang = '{lang}' THEN CAST({has('t', inside)}{begin} AS INT)")
    return f"""WITH {LINES}, x AS (SELECT repo, path, CASE {' '.join(names)} END AS name, CASE {' '.join(asserts)} END AS a FROM l WHERE lang <> 'unknown'),
c AS (SELECT repo, path, count(name) AS test_count, sum(a) AS asserts FROM x GROUP BY ALL),
p AS (SELECT repo, path, max(n) AS most FROM (SELECT repo, path, array_to_string(string_split(name, '_')[1:2], '_') AS s, count(*) AS n FROM x WHERE name IS NOT NULL GROUP BY ALL) GROUP BY ALL)
SELECT repo, path, CAST(test_count AS BIGINT) AS test_count, round(CASE WHEN test_count = 0 THEN 0 ELSE most / test_count END, 6) AS prefix_ratio, round(CASE WHEN test_count = 0 THEN 0 ELSE asserts / test_count END, 6) AS assert_density FROM c LEFT JOIN p USING (repo, path)"""


def _security() -> str:
    parts = []
    for id_, severity, confidence, extensions, fold, pattern in V.SECURITY:
        exts = ", ".join(q(e) for e in (extensions or V.SECURITY_EXTENSIONS))
        # RE2's word classes are ASCII; the rules' own words are, too.
        parts.append(f"SELECT repo, path, '{id_}' AS id, '{severity}' AS severity, CAST({confidence} AS DOUBLE) AS confidence, CAST(no AS INT) AS line FROM l WHERE ext IN ({exts}) AND regexp_matches(raw, {q(pattern)}{', ' + q('i') if fold else ''})")
    return f"WITH {LINES} " + " UNION ALL ".join(parts)


SECURITY = _security()
#: Every character that is no word character is doubled, so that neighbours share none; words with a hyphen have it doubled, too.
WORDS_PATTERN = "(?:^|[^A-Za-z0-9_])(" + "|".join(w.replace("-", "--") for w in sorted(R.WORDS, key=lambda w: (-len(w), w))) + ")(?:[^A-Za-z0-9_]|$)"
WORD_ROWS = f"""SELECT repo, path, no, replace(unnest(regexp_extract_all(regexp_replace(lower(raw), '([^A-Za-z0-9_])', '\\1\\1', 'g'), {q(WORDS_PATTERN)}, 1)), '--', '-') AS word FROM l"""
RECIPE_WORDS = f"WITH {LINES} SELECT repo, path, CAST(no AS INT) AS line, word, count(*) AS n FROM ({WORD_ROWS}) GROUP BY ALL"


def _phrases(items) -> str:
    return "|".join(p.lower() for p in sorted(items, key=lambda p: (-len(p), p)))


RECIPE_PHRASES = f"WITH {LINES} SELECT repo, path, CAST(no AS INT) AS line, phrase, count(*) AS n FROM (SELECT repo, path, no, unnest(regexp_extract_all({low('raw')}, {q(_phrases(R.PHRASES))})) AS phrase FROM l) GROUP BY ALL"
RECIPE_REGEX = f"WITH {LINES} " + " UNION ALL ".join(f"SELECT repo, path, CAST(no AS INT) AS line, '{n}' AS name FROM l WHERE regexp_matches(raw, {q(p)})" for n, (_, p) in R.COMMENTS.items())
RECIPE_CONTEXTUAL = f"WITH {LINES} " + " UNION ALL ".join(f"SELECT repo, path, CAST(no AS INT) AS line, '{n}' AS name FROM l WHERE (name LIKE 'README%.md' OR name = 'readme.md' OR path = 'README.md') AND regexp_matches(raw, {q(p)})" for n, (_, p) in R.README.items())
CLUSTERS = f"""WITH {LINES}, w AS ({WORD_ROWS}), p AS (SELECT repo, path, no, unnest(regexp_extract_all({low('raw')}, {q(_phrases(R.PHRASES))})) AS word FROM l),
u AS (SELECT repo, path, no, 'word' AS kind, word FROM w UNION ALL SELECT repo, path, no, 'phrase', word FROM p),
n AS (SELECT *, count(*) OVER (PARTITION BY repo, path) AS total, count(*) OVER (PARTITION BY repo, path, (no - 1) // 15) AS here FROM u)
SELECT repo, path, CAST((no - 1) // 15 AS BIGINT) AS bucket, count(*) AS n, total >= 4 AND here >= 4 AS boosted FROM n GROUP BY repo, path, (no - 1) // 15, total, here"""

SUPPRESSED = f"""WITH {LINES}, s AS ({SECURITY.split(' ', 1)[1][len(LINES):]}), g AS (SELECT repo, path, no + 1 AS line FROM l WHERE contains(raw, {q(V.IGNORE_NEXT)}))
SELECT repo, path, id, line FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.repo = s.repo AND g.path = s.path AND g.line = s.line)"""
IGNORED = f"WITH {CODE} SELECT repo, count(*) FILTER (contains(content, {q(V.IGNORE_FILE)})) AS ignored, count(*) FILTER (NOT contains(content, {q(V.IGNORE_FILE)})) AS scanned FROM f GROUP BY repo"

_ROWS = ", ".join(f"({k}, {q(path)}, {q(text)})" for k, bundle in enumerate(BUNDLES) for path, text in bundle.items())
REPO = f"""b(k, path, content) AS (VALUES {_ROWS}), repos AS (SELECT DISTINCT source AS repo FROM documents WHERE source IS NOT NULL),
rf AS (SELECT repo, path, content, {low("content")} AS lc, CASE WHEN contains(parse_filename(path), '.') THEN regexp_extract(path, '\\.([^./]+)$', 1) ELSE '' END AS ext FROM repos JOIN b ON CAST(substr(repo, 4) AS INT) % 6 = k),
shape AS (SELECT repo, count(*) FILTER (ext IN {V.CODE_EXTENSIONS}) AS code, count(*) FILTER (ext IN {V.DOC_EXTENSIONS + V.CONFIG_EXTENSIONS}) AS non_code, count(*) FILTER (ext IN {V.IMAGE_EXTENSIONS}) AS images,
 coalesce(max(CASE WHEN path = 'README.md' THEN {hits("lc", V.PROMOTION_MARKERS)} END), 0) AS promo, sum(CASE WHEN ext IN {V.DOC_EXTENSIONS} THEN {hits("lc", V.PLACEHOLDERS)} ELSE 0 END) AS ph,
 max(CASE WHEN path = 'README.md' THEN lc END) AS readme, max(CASE WHEN path = 'Cargo.toml' THEN regexp_extract(content, 'name = "([^"]*)"', 1) END) AS pkg FROM rf GROUP BY repo)"""


def repo_query(body: str) -> str:
    return f"WITH {REPO} {body}"


def _out(high: str, confidence: str, source: str, where: str) -> str:
    return repo_query(f"SELECT repo, CASE WHEN {high} THEN 'high' ELSE 'medium' END AS severity, round(least(1.0, {confidence}), 6) AS confidence FROM {source} WHERE {where}")


WORKFLOW = _out("n >= 5 AND h >= 5", "0.7 * n / 7 + 0.3 * h / 10", f"(SELECT repo, count(*) AS n, sum({hits('lc', V.WORKFLOW_MARKERS)}) AS h FROM rf WHERE path IN {V.WORKFLOW_FILES} GROUP BY repo)", "n >= 3 AND h >= 3")
METADATA = _out("n >= 4 AND h >= 8", "0.6 * n / 5 + 0.4 * h / 12", f"(SELECT repo, count(*) AS n, sum({hits('lc', V.METADATA_MARKERS)}) AS h FROM rf WHERE path IN {V.METADATA_FILES} GROUP BY repo)", "n >= 3 AND h >= 5")
PROMOTION = _out("promo >= 7 AND code <= 2", "0.5 * promo / 10 + 0.3 * images / 6 + 0.2 * (4 - code) / 4", "shape", "promo >= 4 AND images >= 2 AND code <= 4")
MAINTENANCE = _out("code <= 1 AND ph >= 3", "0.5 * non_code / 8 + 0.3 * ph / 6 + 0.2 * least(CASE WHEN code = 0 THEN non_code ELSE non_code / code END, 3) / 3", "shape", "code <= 3 AND non_code >= 5 AND ph >= 2 AND (code = 0 OR non_code / code >= 1.2)")
NAME = _out("g >= 3 AND r >= 5 AND code <= 2", "0.4 * g / 5 + 0.4 * r / 8 + 0.2 * (4 - code) / 4", f"(SELECT *, len(list_filter(string_split_regex(lower(pkg), '[-_]'), lambda x: x IN {V.GENERIC_NAMES})) AS g, (length(readme) - length(replace(readme, replace(lower(pkg), '_', '-'), ''))) // length(pkg) AS r FROM shape WHERE pkg IS NOT NULL)", "g >= 2 AND r >= 3 AND code <= 4")
ARCHITECTURE = f"""WITH {CODE}, r AS (SELECT repo, len(ls) AS n, len(string_split(path, '/')) AS d, list_intersect(string_split(lower(path), '/'), {array(V.LAYERS)}) AS y,
 len(regexp_extract_all(content, '(?m)^\\s*(pub\\s+)?trait\\s+\\w+')) AS t, len(regexp_extract_all(content, '(?m)^\\s*(pub\\s+)?struct\\s+\\w+')) AS s, len(regexp_extract_all(content, '(?m)^\\s*impl\\s+')) AS i FROM f WHERE ext = 'rs')
SELECT repo, CAST(count(*) AS BIGINT) AS source_files, CAST(max(d) AS BIGINT) AS depth, CAST(sum(t) AS BIGINT) AS traits, CAST(sum(s) AS BIGINT) AS structs, CAST(sum(i) AS BIGINT) AS impls, CAST(max(n) AS BIGINT) AS max_lines FROM r GROUP BY repo"""

COMMITS = """c AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type, event_id, user_id, (user_id % 5 - 2) * 60 AS tz,
 CASE WHEN user_id % 5 = 0 THEN 1704067200 + (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 3600 ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS ts,
 CASE WHEN user_id % 5 = 0 THEN 'feat(x): change ' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN event_type = 'click' THEN 'feat: add view' WHEN event_type = 'view' THEN 'docs: notes' WHEN event_type = 'signup' THEN 'update things' WHEN event_type = 'purchase' THEN 'refactor(core): tidy' WHEN event_type = 'error' THEN 'oops wrong path' END AS message FROM events)"""
_CONV = "^(?:" + "|".join(V.CONVENTIONAL_TYPES) + r")(?:\([^)]+\))?!?:"
COMMIT_METRICS = f"""WITH {COMMITS}, g AS (SELECT repo, message, nullif(greatest(ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts), 0), 0) AS gap FROM c)
SELECT repo, CAST(count(*) AS BIGINT) AS commit_count, round(CASE WHEN count(gap) < 2 THEN 0 ELSE stddev_pop(gap) / avg(gap) END, 6) AS cadence_cv,
 round(CASE WHEN count(*) < 2 THEN 0 ELSE avg(CAST(regexp_matches(message, {q(_CONV + chr(92) + 's')}) AS INT)) END, 6) AS conventional_fraction, CAST(CASE WHEN count(*) < 2 THEN 0 ELSE count(*) FILTER ({has('lower(message)', V.RECOVERY)}) END AS BIGINT) AS recovery_count FROM g GROUP BY repo"""


def _commit_findings(digits: int) -> str:
    return f"""SELECT repo, CASE WHEN s = 3 THEN 'high' ELSE 'medium' END AS severity, round(0.5 * (1 - least(cadence_cv, 1)) + 0.3 * conventional_fraction + 0.2 * z, {digits}) AS confidence
FROM (SELECT *, CAST(cadence_cv < 0.35 AS INT) + CAST(conventional_fraction >= 0.87 AS INT) + z AS s FROM (SELECT *, CAST(recovery_count = 0 AND commit_count >= 8 AS INT) AS z FROM ({COMMIT_METRICS}) WHERE commit_count >= 6)) WHERE s >= 2"""


COMMIT_FINDINGS = _commit_findings(4)
SESSIONS = f"""WITH {COMMITS}, n AS (SELECT event_type AS repo, ts, CAST(event_id AS VARCHAR) AS oid, CAST(coalesce(abs(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, CAST(event_id AS VARCHAR))) > 600, false) AS INT) AS new FROM c),
s AS (SELECT repo, ts, oid, sum(new) OVER (PARTITION BY repo ORDER BY ts, oid ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT repo, CAST(session AS BIGINT) AS session, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY repo, session"""
COMMIT_STATS = f"""WITH {COMMITS}, k AS (SELECT *, to_timestamp(ts + tz * 60) AT TIME ZONE 'UTC' AS l FROM c)
SELECT repo, count(*) AS commits, round(avg(hour(l)), 6) AS avg_hour, {', '.join(f"round(count(*) FILTER (isodow(l) = {d + 1}) / count(*), 6) AS day{d}" for d in range(7))}, round(avg(strlen(message)), 6) AS avg_bytes, round(avg(CAST(regexp_matches(message, {q(_CONV)}) AS INT)), 6) AS conventional_rate,
 round(avg(CAST(starts_with(lower(message), 'wip') OR contains(lower(message), ' wip') OR starts_with(lower(message), 'fixup') OR starts_with(lower(message), 'squash') AS INT)), 6) AS wip_rate FROM k GROUP BY repo"""
TOUCHES = f"WITH {COMMITS} SELECT repo, file, count(*) AS touches FROM (SELECT repo, unnest(['src/' || event_type || '.rs', 'docs/' || (event_id % 3) || '.md']) AS file FROM c) GROUP BY ALL"
NOW = 1704067200 + 15 * 86400
QUEUE = f"WITH {COMMITS} SELECT repo, count(*) FILTER (event_id % 4 = 0) AS done, count(*) FILTER (event_id % 4 <> 0 AND ts > {NOW}) AS pending, count(*) FILTER (event_id % 4 <> 0 AND ts <= {NOW}) AS due FROM c GROUP BY repo"

BREAKDOWN = "SELECT doc_id, CASE WHEN doc_id % 5 + doc_id % 3 + doc_id % 4 >= 8 THEN 'high' WHEN doc_id % 5 + doc_id % 3 + doc_id % 4 >= 5 THEN 'medium' ELSE 'low' END AS level FROM documents"
NORMALISE = rf"""WITH {CODE} SELECT repo, path, md5(array_to_string(list_transform(ls, lambda x: regexp_replace(regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s+$', '')), chr(10))) AS digest FROM f"""
BASELINE = f"""WITH {LINES}, c AS (SELECT repo, path, count(*) FILTER (t <> '') AS ne, count(*) FILTER ({COMMENT}) AS cl, count(*) FILTER (starts_with(t, '///') OR starts_with(t, '/**') OR starts_with(t, '//!')) AS dl FROM l WHERE lang <> 'unknown' GROUP BY ALL HAVING count(*) FILTER (t <> '') >= 8),
h AS (SELECT repo, path, {' + '.join(f"(length(lower(content)) - length(replace(lower(content), {q(t)}, ''))) // {len(t)}" for t in V.LEXICAL)} AS terms FROM f)
SELECT count(*) AS files, round(avg(cl / ne), 6) AS comment_density, round(avg(dl / ne), 6) AS doc_ratio, round(100 * sum(terms) / sum(ne), 6) AS terms_per_100_lines, round(least(0.8, greatest(0.2, 1.5 * avg(cl / ne))), 6) AS threshold FROM c JOIN h USING (repo, path)"""
CONVERSATIONS = f"SELECT conv_id, turn, {hits(low('coalesce(text, ' + q('') + ')'), V.PROMPT)} AS markers FROM conversations"
GLOB = f"WITH {CODE} SELECT repo, count(*) AS n FROM f WHERE (path LIKE '%README%.md' OR name LIKE 'README%.md') AND NOT contains(path, '/d7/') GROUP BY repo"
SCOPES = f"WITH {COMMITS} SELECT CAST(event_id AS VARCHAR) AS oid, 'docs+src' AS scope, regexp_replace(message, {q(_CONV + chr(92) + 's*')}, '') AS subject FROM c"


_FN = "CASE " + " ".join(f"WHEN lang = '{n}' THEN regexp_matches(raw, {q(p)})" for n, p in V.FUNCTION_PATTERNS.items()) + " END"
_DOC = "CASE " + " ".join(f"WHEN lang = '{n}' THEN regexp_matches(raw, {q(p)})" for n, p in V.DOC_PATTERNS.items()) + " ELSE false END"
_PUB = "CASE " + " ".join(f"WHEN lang = '{n}' THEN starts_with(ltrim_, {q(p)})" for n, p in V.PUBLIC_STARTS.items()) + " ELSE true END"
_TRIPLE = q('"' * 3)
#: Lines with what the fold needs: running sums of braces where one closes, with and without one opened in the line before.
_STEPS = rf"""bl AS (SELECT repo, path, lang, no, raw, t, {_FN} AS fn, {_DOC} AS doc, {_PUB} AS pub, CASE WHEN t <> '' THEN length(raw) - length(ltrim_) END AS ind,
  starts_with(t, '#') OR starts_with(t, '*') OR starts_with(t, '/*') OR t = '' OR CASE WHEN lang = 'python' THEN starts_with(t, {_TRIPLE}) ELSE starts_with(t, '//') END AS run,
  string_split(regexp_replace(raw, '[^{{}}]', '', 'g'), '') AS br FROM (SELECT *, regexp_replace(raw, '^\s+', '') AS ltrim_ FROM l WHERE lang <> 'unknown')),
br AS (SELECT repo, path, no, k, c, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER w AS s, max(c = '{{') OVER w AS o FROM (SELECT repo, path, no, unnest(br) AS c, generate_subscripts(br, 1) AS k FROM bl) WHERE c <> '' WINDOW w AS (PARTITION BY repo, path, no ORDER BY k)),
bs AS (SELECT repo, path, no, list(s) FILTER (c = '}}') AS any_, list(s) FILTER (c = '}}' AND o) AS own, last(s ORDER BY k) AS total, max(o) AS opens FROM br GROUP BY ALL),
st AS (SELECT bl.*, coalesce(any_, []) AS any_, coalesce(own, []) AS own, coalesce(total, 0) AS total, coalesce(opens, false) AS opens FROM bl LEFT JOIN bs USING (repo, path, no))"""
#: One step of the fold for all files at a time: open, begin, last, depth, seen, indent, doc, pub, behind, and the length of a function that ends before or at the line.
STRUCTURE_FOLD = f"""WITH RECURSIVE {LINES}, {_STEPS},
r(repo, path, no, op, beg, las, dep, seen, ind, d, p, beh, n1, d1, p1, n2, d2, p2) AS (
 SELECT DISTINCT repo, path, CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS HUGEINT), false, CAST(0 AS BIGINT), false, false, false, CAST(NULL AS BIGINT), false, false, CAST(NULL AS BIGINT), false, false FROM st
 UNION ALL
 SELECT repo, path, no, op2, beg2, las2, dep2, seen2, ind2, dd2, pp2, beh2, n1, d, p, CASE WHEN NOT op2 AND (was OR fn) AND fin THEN no - beg2 + 1 END, dd2, pp2 FROM (
  SELECT *, CASE WHEN was THEN NOT fin WHEN fn THEN NOT fin ELSE false END AS op2, CASE WHEN was THEN beg WHEN fn THEN no ELSE beg END AS beg2,
   CASE WHEN was AND lang = 'python' AND xi IS NULL THEN las WHEN was OR fn THEN no ELSE las END AS las2, CASE WHEN was THEN dep + total WHEN fn THEN total ELSE dep END AS dep2, CASE WHEN was THEN seen OR opens WHEN fn THEN opens ELSE seen END AS seen2,
   CASE WHEN NOT was AND fn THEN coalesce(xi, 0) ELSE ind END AS ind2, CASE WHEN NOT was AND fn THEN beh ELSE d END AS dd2, CASE WHEN NOT was AND fn THEN pub ELSE p END AS pp2, CASE WHEN run THEN beh OR doc ELSE false END AS beh2
  FROM (SELECT *, CASE WHEN NOT was AND NOT fn THEN false WHEN lang = 'python' THEN false WHEN was AND seen THEN list_contains(any_, -dep) WHEN was THEN list_contains(own, -dep) ELSE list_contains(own, 0) END AS fin
   FROM (SELECT r.* EXCLUDE (no, n1, d1, p1, n2, d2, p2), st.no, st.lang, st.fn, st.doc, st.pub, st.ind AS xi, st.run, st.any_, st.own, st.total, st.opens,
     r.op AND NOT (lang = 'python' AND st.ind IS NOT NULL AND st.ind <= r.ind) AS was, CASE WHEN r.op AND lang = 'python' AND st.ind IS NOT NULL AND st.ind <= r.ind THEN r.las - r.beg + 1 END AS n1
    FROM r JOIN st ON r.repo = st.repo AND r.path = st.path AND st.no = r.no + 1)))),
e AS (SELECT repo, path, n1 AS n, d1 AS d, p1 AS p FROM r WHERE n1 IS NOT NULL UNION ALL SELECT repo, path, n2, d2, p2 FROM r WHERE n2 IS NOT NULL
 UNION ALL SELECT repo, path, las - beg + 1, d, p FROM r WHERE op QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY no DESC) = 1 AND no = (SELECT max(no) FROM st WHERE st.repo = r.repo AND st.path = r.path)),
g AS (SELECT repo, path, count(*) AS c, stddev_pop(n) / avg(n) AS cv, avg(CAST(d AS INT)) AS dc, avg(CAST(p AS INT)) AS pc FROM e GROUP BY ALL),
sm AS (SELECT f.repo, f.path, lang, CAST(greatest(1, len(ls)) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS function_count, CASE WHEN coalesce(c, 0) < 2 THEN 0 ELSE cv END AS length_cv, coalesce(dc, 0) AS doc_coverage, coalesce(pc, 0) AS pub_fraction FROM f LEFT JOIN g ON f.repo = g.repo AND f.path = g.path WHERE lang <> 'unknown')"""
STRUCTURE = f"{STRUCTURE_FOLD} SELECT repo, path, lang, n_lines, function_count, round(length_cv, 6) AS length_cv, round(doc_coverage, 6) AS doc_coverage, round(pub_fraction, 6) AS pub_fraction FROM sm"

SESSION_COMMITS = f"""{COMMITS}, sn AS (SELECT event_type AS repo, ts, CAST(event_id AS VARCHAR) AS oid, ['src/' || event_type || '.rs', 'docs/' || (event_id % 3) || '.md'] AS files, message,
 CAST(coalesce(abs(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts, CAST(event_id AS VARCHAR))) > 600, false) AS INT) AS new FROM c),
ss AS (SELECT repo, ts, oid, files, message, CAST(sum(new) OVER (PARTITION BY repo ORDER BY ts, oid ROWS UNBOUNDED PRECEDING) AS INT) AS session FROM sn),
sk AS (SELECT *, row_number() OVER (PARTITION BY repo, session ORDER BY ts, oid) AS k FROM ss)"""
#: A commit at a time for all sessions: the group it falls into and the files gathered so far.
GROUP_FOLD = f"""WITH RECURSIVE {SESSION_COMMITS},
gf(repo, session, k, grp, seen) AS (SELECT repo, session, k, 0, files FROM sk WHERE k = 1
 UNION ALL SELECT s.repo, s.session, s.k, CASE WHEN list_has_any(g.seen, s.files) THEN grp ELSE grp + 1 END, CASE WHEN list_has_any(g.seen, s.files) THEN list_distinct(list_concat(g.seen, s.files)) ELSE s.files END
 FROM gf g JOIN sk s ON s.repo = g.repo AND s.session = g.session AND s.k = g.k + 1),
gg AS (SELECT sk.repo, sk.session, grp, list(oid ORDER BY sk.k) AS oids, list_sort(list_distinct(flatten(list(files)))) AS files, CAST(count(*) AS INT) AS n_commits FROM sk JOIN gf ON sk.repo = gf.repo AND sk.session = gf.session AND sk.k = gf.k GROUP BY ALL)"""
GROUPS = f"{GROUP_FOLD} SELECT repo, session, grp, array_to_string(oids, ',') AS oids, array_to_string(files, ',') AS files, n_commits FROM gg"


def replay(first: int, step: int) -> str:
    """Without windows every target lies an hour after the moment that the step leads to."""
    top = "list_sort(list_distinct(list_transform(files, lambda x: string_split(x, '/')[1])))"
    return f"""{GROUP_FOLD} SELECT repo, session, grp, n_commits, CASE WHEN n_commits > 1 THEN 'squash' WHEN len({top}) > 2 THEN 'split' ELSE 'replay' END AS action,
 CASE len({top}) WHEN 0 THEN 'core' WHEN 1 THEN {top}[1] ELSE {top}[1] || '+' || {top}[2] END AS scope, CAST({first} + (row_number() OVER (PARTITION BY repo ORDER BY session, grp) - 1) * {step} AS BIGINT) AS target FROM gg"""


REPLAY = replay(NOW + 3600, (24 + 6 + 60) * 60)


def text_lines(source: str, name: str) -> str:
    """(repo, path, ext, content, no, raw, t) of a relation's contents, as `name`."""
    ls = "CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END"
    return rf"""{name} AS (SELECT repo, path, ext, content, no, raw, {trim("raw")} AS t FROM (SELECT repo, path, ext, content, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM (SELECT repo, path, ext, content, {ls} AS ls FROM (SELECT *, string_split_regex(content, '\r?\n') AS ls FROM {source}))))"""


def thinned(source: str) -> str:
    """thin: (repo, path, ext, content, removed)."""
    at = "low_"
    return f"""{text_lines(source, "tl")},
t0 AS (SELECT *, {COMMENT} AS own, {low(BODY)} AS low_ FROM tl),
t1 AS (SELECT *, CASE WHEN own THEN array_to_string(string_split_regex(low_, '\\s+')[1:3], ' ') ELSE '' END AS prefix, own AND NOT {has(at, V.PRESERVE)} AS may, own AND NOT {has(at, V.PRESERVE)} AND ({has(at, V.TUTORIAL)} OR {' OR '.join(f"starts_with(low_, {q(x)})" for x in V.TUTORIAL_STARTS)}) AS narrates FROM t0),
t2 AS (SELECT *, coalesce(may AND prefix <> '' AND prefix = lag(prefix) OVER (PARTITION BY repo, path ORDER BY no), false) AS repeats FROM t1 WHERE NOT narrates),
t3 AS (SELECT repo, path, string_agg(raw, chr(10) ORDER BY no) FILTER (NOT repeats) AS body, count(*) FILTER (NOT repeats) AS kept FROM t2 GROUP BY ALL),
t4 AS (SELECT repo, path, count(*) AS n FROM tl GROUP BY ALL),
thin AS (SELECT s.repo, s.path, s.ext, coalesce(body, '') || CASE WHEN suffix(s.content, chr(10)) THEN chr(10) ELSE '' END AS content, CAST(coalesce(t4.n, 0) - coalesce(kept, 0) AS INT) AS removed FROM {source} s LEFT JOIN t3 ON s.repo = t3.repo AND s.path = t3.path LEFT JOIN t4 ON s.repo = t4.repo AND s.path = t4.path)"""


def _map(table: dict) -> str:
    return f"MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in table.items())}}}"


_HYPHENED = "|".join(w for w in sorted(R.WORDS, key=lambda w: (-len(w), w)) if "-" in w)
_WORD_TABLE = _map({k.lower(): v for k, v in R.WORDS.items()})
_PHRASE_TABLE = _map({p.lower(): r for p, r in reversed([*R.PHRASES.items(), *((p, r) for p, (_, r) in R.TURNS.items() if r is not None)])})
_PHRASE_PATTERN = "(?i)(?:" + _phrases({*R.PHRASES, *(p for p, (_, r) in R.TURNS.items() if r is not None)}) + ")"


def swapped(source: str) -> str:
    """swap: (repo, path, ext, content, n): words by pieces of word characters and others, then phrases, then normalised."""
    clean = rf"array_to_string(list_transform(CASE WHEN ls[len(ls)] = '' THEN ls[1:len(ls) - 1] ELSE ls END, lambda x: regexp_replace(regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s+$', '')), chr(10))"
    return rf"""w0 AS (SELECT repo, path, ext, content, regexp_extract_all(content, {q(r"(?i)(?:" + _HYPHENED + r")\b|[A-Za-z0-9_]+|(?s:[^A-Za-z0-9_]+)")}) AS w FROM {source}),
w1 AS (SELECT repo, path, ext, content, w, list_transform(w, lambda x: {_WORD_TABLE}[lower(x)]) AS new FROM w0),
w2 AS (SELECT repo, path, ext, content, array_to_string(list_transform(w, lambda x, i: coalesce(new[i], x)), '') AS t, len(list_filter(new, lambda x: x IS NOT NULL)) AS n FROM w1),
w3 AS (SELECT *, regexp_extract_all(t, {q(_PHRASE_PATTERN)}) AS m, string_split_regex(t, {q(_PHRASE_PATTERN)}) AS b FROM w2),
w4 AS (SELECT repo, path, ext, content, array_to_string(list_transform(b, lambda x, i: x || CASE WHEN i <= len(m) THEN coalesce({_PHRASE_TABLE}[{low("m[i]")}], m[i]) ELSE '' END), '') AS t, n + len(m) AS n FROM w3),
swap AS (SELECT repo, path, ext, CASE WHEN n > 0 THEN {clean} ELSE content END AS content, CAST(n AS INT) AS n FROM (SELECT *, string_split_regex(t, '\r?\n') AS ls FROM w4))"""


def cleaned(source: str) -> str:
    """clean: (repo, path, ext, content, removed)."""
    title = low(trim("regexp_replace(t, '^#+', '')"))
    return f"""{text_lines(source, "rl")},
r0 AS (SELECT *, starts_with(t, '#') AS head, {has(low("raw"), V.README_PHRASES)} AS phrase, starts_with(t, '#') AND {title} IN ({', '.join(map(q, V.README_DROPPABLE))}) AS template FROM rl),
r1 AS (SELECT repo, path, no, template AND coalesce(lead(head) OVER (PARTITION BY repo, path ORDER BY no), true) AS gone FROM r0 WHERE head OR (NOT phrase AND t <> '')),
r2 AS (SELECT r0.*, t = '' AND coalesce(lag(t) OVER (PARTITION BY r0.repo, r0.path ORDER BY r0.no) = '', false) AS again FROM r0 LEFT JOIN r1 ON r0.repo = r1.repo AND r0.path = r1.path AND r0.no = r1.no WHERE NOT phrase AND NOT coalesce(gone, false)),
r3 AS (SELECT repo, path, count(*) AS kept, string_agg(raw, chr(10) ORDER BY no) FILTER (NOT again) AS body FROM r2 GROUP BY ALL), r4 AS (SELECT repo, path, count(*) AS n FROM rl GROUP BY ALL),
clean AS (SELECT s.repo, s.path, s.ext, CASE WHEN r4.n IS NULL THEN '' ELSE coalesce(body, '') || CASE WHEN suffix(s.content, chr(10)) THEN chr(10) ELSE '' END END AS content, CAST(coalesce(r4.n, 0) - coalesce(kept, 0) AS INT) AS removed FROM {source} s LEFT JOIN r3 ON s.repo = r3.repo AND s.path = r3.path LEFT JOIN r4 ON s.repo = r4.repo AND s.path = r4.path)"""


THIN = f"WITH {CODE}, {thinned('code')} SELECT repo, path, md5(content) AS digest, removed AS removed_comments FROM thin"
SWAP = f"WITH {CODE}, {swapped('code')} SELECT repo, path, md5(content) AS digest, n AS replacements FROM swap"
CLEAN = f"WITH {CODE}, md AS (SELECT * FROM code WHERE ext = 'md'), {cleaned('md')} SELECT repo, path, md5(content) AS digest, removed AS removed_lines FROM clean"
TRANSFORMED = f"""WITH {CODE}, wanted AS (SELECT * FROM code WHERE NOT contains(content, {q(V.IGNORE_FILE)})), {thinned('wanted')}, {swapped('thin')}, md AS (SELECT * FROM swap WHERE ext = 'md'), {cleaned('md')}
SELECT count(*) FILTER (coalesce(clean.content, swap.content) <> wanted.content) AS files_changed, CAST(sum(swap.n) AS BIGINT) AS replacements, CAST(sum(thin.removed) + coalesce(sum(clean.removed), 0) AS BIGINT) AS removed
FROM wanted JOIN thin ON wanted.repo = thin.repo AND wanted.path = thin.path JOIN swap ON wanted.repo = swap.repo AND wanted.path = swap.path LEFT JOIN clean ON wanted.repo = clean.repo AND wanted.path = clean.path"""


def _matches(lists: str, recipe: str, kind: str) -> str:
    """Every match of the lists (repo, path, no, g) with its place in the line."""
    key = "key" if kind == "word" else "replace(key, ' ', '-')"
    return f"SELECT repo, path, no, nth, '{recipe}' AS recipe, '{kind}' AS kind, key, {key} AS name FROM (SELECT repo, path, no, unnest(g) AS key, generate_subscripts(g, 1) - 1 AS nth FROM ({lists}))"


def _recipe_matches() -> str:
    words = f"SELECT repo, path, no, list_transform(regexp_extract_all(regexp_replace(lower(raw), '([^A-Za-z0-9_])', '\\1\\1', 'g'), {q(WORDS_PATTERN)}, 1), lambda x: replace(x, '--', '-')) AS g FROM l"
    phrases = lambda items: f"SELECT repo, path, no, regexp_extract_all({low('raw')}, {q(_phrases(items))}) AS g FROM l"
    parts = [_matches(words, "slop-vocabulary", "word"), _matches(phrases(R.PHRASES), "slop-vocabulary", "phrase"), _matches(phrases(R.TURNS), "phrase-patterns", "phrase")]
    single = "SELECT repo, path, no, 0 AS nth, '{}' AS recipe, '{}' AS kind, '{}' AS key, '{}' AS name FROM l WHERE {}regexp_matches(raw, {})"
    parts += [single.format("comment-patterns", "regex", n, n, "", q(p)) for n, (_, p) in R.COMMENTS.items()]
    parts += [single.format("phrase-patterns", "contextual", n, n, "(name LIKE 'README%.md' OR name = 'readme.md' OR path = 'README.md') AND ", q(p)) for n, (_, p) in R.README.items()]
    return " UNION ALL ".join(parts)


def _severities() -> str:
    rows = [("phrase-patterns", low_text(p), p.replace(" ", "-"), s, r) for p, (s, r) in R.TURNS.items()]
    rows += [("slop-vocabulary", w.lower(), w, "low", r) for w, r in R.WORDS.items()] + [("slop-vocabulary", low_text(p), p.replace(" ", "-"), "medium", r) for p, r in R.PHRASES.items()]
    rows += [("comment-patterns", n, n, s, None) for n, (s, _) in R.COMMENTS.items()] + [("phrase-patterns", n, n, s, None) for n, (s, _) in R.README.items()]
    return ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {q(d)}, {'NULL' if e is None else q(e)})" for a, b, c, d, e in rows)


def low_text(x: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in x)


_SCORING = ", ".join(f"({q(n)}, {k}, {t}, {b}, {q(boost)}, {c}, {q('comment' if n == 'comment-patterns' else 'lexical')})" for k, (n, (t, b, boost, c)) in enumerate(R.SCORING.items()))
_TRIO = lambda order, detector, id_, category: f"'{detector}' AS detector, '{id_}' AS id, '{category}' AS category, CAST({order} AS BIGINT) * 1000000000000 AS ord"
_WHOLE_FILE = "CAST(1 AS INT) AS line_start, n_lines AS line_end"


def _repo(order: int, detector: str, id_: str, category: str, body: str) -> str:
    return f"SELECT repo, '' AS path, {_TRIO(order, detector, id_, category)}, severity, confidence, CAST(NULL AS INT) AS line_start, CAST(NULL AS INT) AS line_end, CAST(NULL AS VARCHAR) AS suggestion FROM ({body})"


#: The findings of all detectors over files, repositories and commits, with the ignore directives applied.
WHOLE = f"""{STRUCTURE_FOLD},
fl AS (SELECT repo, path, CAST(greatest(1, len(ls)) AS INT) AS n_lines FROM f),
cl AS (SELECT repo, path, CAST(min(no) AS INT) AS a, CAST(max(no) AS INT) AS b FROM l WHERE {COMMENT} GROUP BY ALL),
sg AS (SELECT repo, path, length_cv, doc_coverage, CAST(length_cv < 0.25 AS INT) + CAST(doc_coverage >= 0.88 AS INT) + CAST(pub_fraction >= 0.93 AS INT) AS g FROM sm WHERE function_count >= 5),
sc(recipe, k, t, bucket, boost, base, category) AS (VALUES {_SCORING}), sv(recipe, key, name, severity, suggestion) AS (VALUES {_severities()}),
rm AS ({_recipe_matches()}),
rn AS (SELECT rm.repo, path, no, nth, rm.recipe, kind, coalesce(sv.name, rm.name) AS name, coalesce(sv.severity, CASE kind WHEN 'word' THEN 'low' ELSE 'medium' END) AS severity, k, base, category, boost, suggestion,
 count(*) OVER (PARTITION BY rm.repo, path, rm.recipe) >= t AND count(*) OVER (PARTITION BY rm.repo, path, rm.recipe, (no - 1) // bucket) >= t AS hot FROM rm JOIN sc ON rm.recipe = sc.recipe LEFT JOIN sv ON sv.recipe = rm.recipe AND sv.key = rm.key),
ff AS (SELECT repo, path, {_TRIO(1, "lexical", "lexical.cluster", "lexical")}, severity, confidence, line_start, line_end, CAST(NULL AS VARCHAR) AS suggestion FROM ({LEXICAL_FINDINGS})
 UNION ALL SELECT repo, path, {_TRIO(2, "comments", "comments.over_documented", "comment")}, severity, confidence, a, b, NULL FROM ({_comment_findings(12, _comments(12))}) JOIN cl USING (repo, path)
 UNION ALL SELECT repo, path, {_TRIO(3, "structure", "structure.uniform", "structure")}, CASE WHEN g = 3 OR length_cv < 0.10 THEN 'high' ELSE 'medium' END, least(1.0, greatest(0.0, 0.9 * (0.5 * (1 - length_cv) + 0.3 * doc_coverage))), {_WHOLE_FILE}, NULL FROM sg JOIN fl USING (repo, path) WHERE g >= 2
 UNION ALL SELECT repo, path, {_TRIO(4, "tests", "tests.symmetric.shape", "test_pattern")}, CASE WHEN prefix_ratio > 0.80 AND assert_density > 0.70 THEN 'high' ELSE 'medium' END, least(1.0, 0.6 * prefix_ratio + 0.4 * assert_density), {_WHOLE_FILE}, NULL FROM ({_tests()}) JOIN fl USING (repo, path) WHERE test_count >= 6 AND prefix_ratio >= 0.65 AND assert_density >= 0.5
 UNION ALL SELECT repo, path, {_TRIO(5, "idiom", "idiom.cross_language.mismatch", "idiom_mismatch")}, severity, confidence, {_WHOLE_FILE}, NULL FROM ({IDIOM}) JOIN fl USING (repo, path)
 UNION ALL SELECT repo, path, {_TRIO(6, "prompt", "prompt.leakage.markers", "prompt_leakage")}, severity, confidence, {_WHOLE_FILE}, NULL FROM ({PROMPT}) JOIN fl USING (repo, path)
 UNION ALL SELECT repo, path, {_TRIO(7, "readme", "readme.template.structure", "readme")}, severity, confidence, {_WHOLE_FILE}, NULL FROM ({README}) JOIN fl USING (repo, path)
 UNION ALL SELECT repo, path, 'security', id, 'security', 8000000000000 + CAST(line AS BIGINT) * 100 + CAST(substr(id, 4) AS INT) - 1, severity, confidence, line, line, NULL FROM ({SECURITY})
 UNION ALL SELECT repo, path, 'recipe', recipe || ':' || kind || ':' || name, category, (20 + k) * 1000000000000 + no * 1000 + nth, CASE WHEN hot THEN boost ELSE severity END, CASE WHEN hot THEN least(1.0, base + 0.15) ELSE base END, CAST(no AS INT), CAST(no AS INT), suggestion FROM rn),
am AS (SELECT repo, len(list_distinct(flatten(list(y)))) AS layers, sum(t) AS traits, sum(s) AS structs, sum(i) AS impls, count(*) AS source_files, max(d) AS depth FROM (SELECT repo, len(string_split(path, '/')) AS d, list_intersect(string_split(lower(path), '/'), {array(V.LAYERS)}) AS y,
 len(regexp_extract_all(content, '(?m)^\\s*(pub\\s+)?trait\\s+\\w+')) AS t, len(regexp_extract_all(content, '(?m)^\\s*(pub\\s+)?struct\\s+\\w+')) AS s, len(regexp_extract_all(content, '(?m)^\\s*impl\\s+')) AS i FROM f WHERE ext = 'rs') GROUP BY repo HAVING count(*) >= 8),
ar AS (SELECT repo, '' AS path, 1 AS k, 'medium' AS severity, 0.75 AS confidence FROM am WHERE depth < 2 UNION ALL SELECT repo, '', 2, 'medium', 0.70 FROM am WHERE layers < 2 AND source_files >= 16 UNION ALL SELECT repo, path, 3, 'high', 0.85 FROM f WHERE ext = 'rs' AND len(ls) > 800 AND repo IN (SELECT repo FROM am)
 UNION ALL SELECT repo, '', 4, 'medium', 0.65 FROM am WHERE structs >= 5 AND traits / (traits + structs) < 0.02 UNION ALL SELECT repo, '', 5, 'low', 0.60 FROM am WHERE structs >= 5 AND (CASE WHEN impls / structs < 0.5 THEN floor(structs * (1 - 2 * impls / structs)) ELSE 0 END) / structs > 0.80),
hu AS (SELECT repo, path, no + 1 AS line FROM l WHERE contains(raw, {q(V.IGNORE_NEXT)})), ig AS (SELECT repo, path FROM f WHERE contains(content, {q(V.IGNORE_FILE)})),
found AS (SELECT * FROM ff WHERE NOT EXISTS (SELECT 1 FROM hu WHERE hu.repo = ff.repo AND hu.path = ff.path AND hu.line = ff.line_start) AND NOT EXISTS (SELECT 1 FROM ig WHERE ig.repo = ff.repo AND ig.path = ff.path)
 UNION ALL SELECT repo, path, 'architecture', 'ARCH00' || k, 'architecture', (50 + k) * CAST(1000000000000 AS BIGINT), severity, CAST(confidence AS DOUBLE), NULL, NULL, NULL FROM ar
 UNION ALL {_repo(40, "commit_pattern", "commit_pattern.machine_clean", "commit_pattern", _commit_findings(8))} UNION ALL {_repo(60, "workflow", "workflow.artifact.bundle", "workflow", WORKFLOW)} UNION ALL {_repo(61, "metadata", "metadata.scaffold.bundle", "metadata", METADATA)}
 UNION ALL {_repo(62, "promotion", "promotion.showcase_stack", "promotion", PROMOTION)} UNION ALL {_repo(63, "maintenance", "maintenance.hollow_repo", "maintenance", MAINTENANCE)} UNION ALL {_repo(64, "name_credibility", "name.discovery_pollution", "name_credibility", NAME)})"""
SCAN = f"{WHOLE} SELECT repo, path, detector, id, category, severity, round(confidence, 4) AS confidence, line_start, line_end FROM found"


_W = "CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.2 END"
_TOTALS = f"count(*) AS total, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, round(coalesce(1 / (1 + exp(-8 * (avg({_W} * confidence) - 0.5))), 0), 4) AS ai_probability"
SUMMARY = f"{WHOLE} SELECT {_TOTALS} FROM found"
CONTRIBUTIONS = f"{WHOLE} SELECT category, count(*) AS n, round(sum({_W} * confidence), 4) AS contribution FROM found GROUP BY category"
GRADES = f"""{WHOLE}, nine(grade_category, weight) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in V.GRADE_WEIGHTS.items())}),
gr AS (SELECT CASE category {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in V.GRADE_OF.items())} END AS grade_category, count(*) AS n, sum(CASE severity WHEN 'high' THEN 3.0 WHEN 'medium' THEN 1.5 ELSE 0.5 END * confidence) AS raw FROM found GROUP BY 1),
s AS (SELECT grade_category, weight, coalesce(n, 0) AS n, least(100.0, coalesce(raw, 0) * 3.33) AS score FROM nine LEFT JOIN gr USING (grade_category))"""
_BAND = "CASE " + " ".join(f"WHEN score <= {m} THEN '{n}'" for m, n in V.GRADE_BANDS) + " ELSE 'F' END"
_OVERALL = "SELECT coalesce(sum(score * weight) FILTER (n > 0) / sum(weight) FILTER (n > 0), 0) AS score, sum(n) AS n FROM s"
GRADE_CATEGORIES = f"{GRADES} SELECT grade_category, n, round(CAST(score AS DOUBLE), 2) AS score, {_BAND} AS grade FROM s"
GRADE_OVERALL = f"{GRADES} SELECT round(CAST(score AS DOUBLE), 2) AS score, {_BAND} AS grade FROM ({_OVERALL})"
EVIDENCE = f"{WHOLE} SELECT repo, path, id, round({_W} * confidence, 4) AS contribution FROM found ORDER BY {_W} * confidence DESC, repo, path, id, ord LIMIT 5"
MIXED = f"""{WHOLE} SELECT repo, path, category, CAST((line_start - 1) // 80 AS BIGINT) AS segment, max(CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) AS best FROM found WHERE line_start IS NOT NULL GROUP BY ALL
 UNION ALL SELECT repo, path, category, NULL, CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END FROM found WHERE line_start IS NULL"""
ROLLUP = f"{WHOLE} SELECT repo, category, severity, count(*) AS n FROM found GROUP BY ROLLUP (repo, category, severity)"
CALIBRATE = f"{WHOLE} SELECT CASE WHEN count(*) FILTER (severity = 'high') = 0 AND count(*) FILTER (severity = 'medium') <= 1 THEN 'high' ELSE 'medium' END AS min_severity, CAST(0.45 AS DOUBLE) AS comment_threshold FROM found"
FILTERED = f"{WHOLE} SELECT severity, count(*) AS n FROM found WHERE severity IN ('medium', 'high') GROUP BY severity"
CATEGORIES = f"{WHOLE} SELECT repo, category, count(*) AS n FROM found WHERE category IN ('security', 'comment') AND confidence >= 0.75 GROUP BY ALL"
_RULE = "'inkstrata/' || category || '/' || id"
RULES = f"""{WHOLE}, ranked AS (SELECT *, {_RULE} AS rule, row_number() OVER (ORDER BY repo, path, ord, id) - 1 AS place FROM found),
rules AS (SELECT rule, any_value(category) AS category, count(*) AS n, row_number() OVER (ORDER BY min(place)) - 1 AS rule_index FROM ranked GROUP BY rule)"""
SARIF = f"{RULES} SELECT rule, CAST(rule_index AS INT) AS rule_index, n FROM rules"
_LEVEL = "CASE severity WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
_TEXT = "id || ' (' || severity || ')'"
SARIF_REPORT = f"""{RULES} SELECT 'rule' AS part, CAST(rule_index AS BIGINT) AS place, CAST(json_object('id', rule, 'shortDescription', json_object('text', category || ' detector')) AS VARCHAR) AS value FROM rules
 UNION ALL SELECT 'result', place, '{{"ruleId":' || to_json(ranked.rule) || ',"ruleIndex":' || rule_index || ',"level":"' || {_LEVEL} || '","message":{{"text":' || to_json({_TEXT}) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(path) || ',"uriBaseId":"%SRCROOT%"}}'
 || CASE WHEN line_start IS NULL THEN '' ELSE ',"region":{{"startLine":' || line_start || ',"endLine":' || line_end || '}}' END || '}}}}],"properties":{{"confidenceScore":' || CAST(CAST(round(confidence, 4) AS DOUBLE) AS VARCHAR) || ',"autoFixable":' || CASE WHEN suggestion IS NULL THEN 'false' ELSE 'true' END || '}}'
 || CASE WHEN suggestion IS NULL THEN '' ELSE ',"fixes":[{{"description":{{"text":' || to_json(suggestion) || '}}}}]' END || '}}' FROM ranked JOIN rules ON ranked.rule = rules.rule
 UNION ALL SELECT 'summary', 0, CAST(json_object('total', total, 'low', low, 'medium', medium, 'high', high, 'ai_probability', ai_probability) AS VARCHAR) FROM (SELECT {_TOTALS} FROM found)"""
JSON_REPORT = f"""{RULES} SELECT 'summary' AS part, CAST(0 AS BIGINT) AS place, CAST(json_object('total', total, 'low', low, 'medium', medium, 'high', high, 'ai_probability', ai_probability) AS VARCHAR) AS value FROM (SELECT {_TOTALS} FROM found)
 UNION ALL SELECT 'finding', place, CAST(json_object('repo', repo, 'path', path, 'id', id, 'category', category, 'severity', severity, 'confidence', CAST(round(confidence, 4) AS DOUBLE), 'line_start', line_start, 'line_end', line_end, 'suggestion', suggestion) AS VARCHAR) FROM ranked
 UNION ALL SELECT 'category', row_number() OVER (ORDER BY category) - 1, CAST(json_object('category', category, 'n', n, 'contribution', c) AS VARCHAR) FROM (SELECT category, count(*) AS n, CAST(round(sum({_W} * confidence), 4) AS DOUBLE) AS c FROM found GROUP BY category)"""
GRADE_REPORT = f"""{GRADES} SELECT CAST(row_number() OVER (ORDER BY grade_category) AS INT) AS place, rpad(grade_category, 14, ' ') || lpad(printf('%.1f', CAST(score AS DOUBLE)), 8, ' ') || lpad({_BAND}, 6, ' ') AS value FROM s WHERE n > 0
 UNION ALL SELECT 99, rpad('overall', 14, ' ') || lpad(printf('%.1f', CAST(score AS DOUBLE)), 8, ' ') || lpad({_BAND}, 6, ' ') FROM ({_OVERALL})"""
_ESCAPED = "replace(replace(replace({}, '%', '%25'), chr(13), '%0D'), chr(10), '%0A')"
ANNOTATIONS = f"""{WHOLE} SELECT repo, '::error file=' || {_ESCAPED.format('path')} || CASE WHEN line_start IS NULL THEN '' ELSE ',line=' || line_start END || ',title=inkstrata[' || category || ']: ' || id || '::' || {_ESCAPED.format(_TEXT)} AS annotation FROM found
 UNION ALL SELECT NULL, '::notice title=inkstrata summary::' || total || ' finding(s), AI probability ' || CAST(round(100 * ai_probability) AS INT) || '%' FROM (SELECT {_TOTALS} FROM found)"""
EVAL = f"""{WHOLE}, hit AS (SELECT DISTINCT TRY_CAST(regexp_extract(path, '(?:/src/f|/d)([0-9]+)', 1) AS BIGINT) AS doc_id FROM found WHERE severity IN ('medium', 'high')),
lx AS (SELECT quality = 0 AS e, doc_id IN (SELECT doc_id FROM hit WHERE doc_id IS NOT NULL) AS p FROM labels JOIN documents USING (doc_id)),
m AS (SELECT count(*) FILTER (p AND e) AS tp, count(*) FILTER (NOT p AND NOT e) AS tn, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (NOT p AND e) AS fn FROM lx)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy FROM m"""
