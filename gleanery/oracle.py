"""Independent SQL for the registered queries, in the dialect of DuckDB."""

from __future__ import annotations

from gleanery import workload as w
from gleanery.functions.analysis import query_phrases
from gleanery.functions.text import CODE_SUFFIXES, CONVERT_SUFFIXES, SPACES, TEXT_SUFFIXES, WS_CLASS, WS_IN_LINE_CLASS
from gleanery.operators.embedding import PRICE_PER_MILLION

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{Co}}]+')"
BLANKS = " || ".join(f"chr({ord(c)})" for c in SPACES)
NL = "chr(10)"
DOC_DATE = (
    "'2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || "
    "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T08:30:00+00:00'"
)


def text_in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CORPUS = f"""corpus AS (
  SELECT doc_id, source, 'notes/' || doc_id || '.txt' AS path, {DOC_DATE} AS doc_date, text FROM documents)"""

ROUTED = f"""routed AS (
  SELECT doc_id, source, {DOC_DATE} AS doc_date, text,
    CASE doc_id % 6 WHEN 0 THEN 'notes/' || doc_id || '.txt' WHEN 1 THEN 'notes/' || doc_id || '.MD'
      WHEN 2 THEN 'src/deep/' || doc_id || '.py' WHEN 3 THEN 'tables/' || doc_id || '.csv'
      WHEN 4 THEN 'bin/.' || doc_id ELSE 'commit/' || sha256(CAST(doc_id AS VARCHAR)) END AS path
  FROM documents)"""

# One paragraph per document: none of the given texts holds a blank line.
def prose_chunks(docs: str, name: str = "chunks") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (body), i AS seq,
    source || '/' || path || {NL} || {NL} || substr(body, i * 4000 + 1, 4000) AS text
  FROM (SELECT * EXCLUDE (text), trim(text, {BLANKS}) AS body, 
          unnest(range(CAST(ceil(length(trim(text, {BLANKS})) / 4000.0) AS BIGINT))) AS i FROM {docs}))"""


CHUNKS = f"{CORPUS}, {prose_chunks('corpus')}"

MAIL = """mail AS (
  SELECT o_orderkey AS doc_id, 'mail' AS source,
    year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) || '/' || o_orderkey || '.eml' AS path,
    'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS doc_date,
    (CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE c_name END) || ' <' || replace(c_name, '#', '.') || '+'
      || lower(substr(o_orderpriority, 1, 1)) || '@' || c_mktsegment || '.example.com>' AS sender,
    receivers
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (
    SELECT l_orderkey, string_agg(r, ', ' ORDER BY r) AS receivers FROM (
      SELECT DISTINCT l_orderkey, s_name || ' <' || lower(replace(s_name, '#', '.')) || '@suppliers.example.com>' AS r
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1) ON l_orderkey = o_orderkey)"""

FOUND = MAIL + r""", headers AS (
  SELECT doc_id, source, path, 'from' AS rel, [sender] AS parts FROM mail
  UNION ALL SELECT doc_id, source, path, 'to', string_split(receivers, ', ') FROM mail WHERE receivers IS NOT NULL),
parts AS (
  SELECT doc_id, source, path, rel, unnest(parts) AS part, generate_subscripts(parts, 1) + CASE rel WHEN 'to' THEN 0 ELSE -1 END AS n
  FROM headers),
found AS (
  SELECT doc_id, source, path, rel, n, 'email' AS kind,
    lower(regexp_replace(regexp_extract(part, '<([^>]*)>', 1), '\+[^@]*@', '@')) AS key,
    regexp_extract(part, '^(.*) <', 1) AS display FROM parts)"""


def alias_values() -> str:
    rows = []
    for address, person in w.ALIASES.alias_of.items():
        local, domain = address.lower().split("@")
        rows.append(f"('{local.split('+')[0]}@{domain}', '{person}')")
    return ", ".join(rows)


GRAPH = FOUND + f""", alias_of(email, person) AS (VALUES {alias_values()}),
member_of(person_key, org) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in w.ALIASES.member_of.items())}),
aliased AS (
  SELECT DISTINCT email, person, trim(lower(regexp_replace(person, '[^A-Za-z0-9 ]', '', 'g'))) AS person_key
  FROM alias_of JOIN found ON key = email),
links AS (
  SELECT DISTINCT 'email' AS a_kind, email AS a_key, 'alias_of' AS rel, 'person' AS b_kind, person_key AS b_key, person AS b_display FROM aliased
  UNION SELECT DISTINCT 'person', person_key, 'member_of', 'org', trim(lower(replace(org, '.', ''))), org
  FROM aliased JOIN member_of USING (person_key))"""

VOTES = """votes AS (
  SELECT key, display, count(*) AS votes, min((source, path, n)) AS first_at FROM found GROUP BY 1, 2),
shown AS (
  SELECT key, display FROM votes QUALIFY row_number() OVER (PARTITION BY key ORDER BY votes DESC, first_at, display) = 1)"""


# --- full text ------------------------------------------------------------------------


def phrase_count(words: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({words}, lambda t: t = '{phrase[0]}'))"
    here = " AND ".join(f"{words}[i + {j}] = '{t}'" for j, t in enumerate(phrase))
    return f"len(list_filter(range(1, len({words}) - {len(phrase) - 2}), lambda i: {here}))"


def bm25_ctes(docs: str, phrases: list[list[str]], keys: str, words: str = WORDS.format("text")) -> str:
    counts = ", ".join(f"{phrase_count('ws', p)} AS f{i}" for i, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(phrases)))
    parts = []
    for i in range(len(phrases)):
        idf = f"ln((n - d{i} + 0.5::DOUBLE) / (d{i} + 0.5::DOUBLE))"
        parts.append(
            f"(CASE WHEN {idf} <= 0 THEN 1e-6::DOUBLE ELSE {idf} END) * (f{i} * 2.2::DOUBLE)"
            f" / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))"
        )
    every = " AND ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""
words AS (SELECT {keys}, {words} AS ws FROM {docs}),
counted AS (SELECT * EXCLUDE (ws), len(ws) AS dl, {counts} FROM words),
totals AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM counted),
scored AS (SELECT {keys}, {" + ".join(parts)} AS score FROM counted, totals WHERE {every})"""


def lexical(query: str, where: str = "true") -> str:
    ctes = bm25_ctes("corpus", query_phrases(query, "simple"), "doc_id, source, doc_date")
    return f"""WITH {CORPUS}, {ctes}
SELECT doc_id, source, round(score, 6) AS score FROM scored WHERE {where}
ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 50"""


# --- stemming --------------------------------------------------------------------------

FOLDED = WORDS.replace("lower({0})", "strip_accents(lower({0}))")

# The paper's rules, longest suffix first within each step.
PORTER_2 = """ational>ate ization>ize iveness>ive fulness>ful ousness>ous tional>tion biliti>ble entli>ent ousli>ous
ation>ate alism>al aliti>al iviti>ive enci>ence anci>ance izer>ize logi>log alli>al ator>ate bli>ble eli>e"""
PORTER_3 = "icate>ic ative> alize>al iciti>ic ical>ic ness> ful>"
PORTER_4 = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou"


def shape(word: str) -> str:
    x = f"regexp_replace(regexp_replace({word}, '[aeiou]', 'V', 'g'), '[^Vy]', 'C', 'g')"
    for _ in range(4):
        x = rf"replace(regexp_replace({x}, '(^|V)y', '\1C', 'g'), 'Cy', 'CV')"
    return x


def measure(n: str) -> str:
    return f"((length(substr(s, 1, {n})) - length(replace(substr(s, 1, {n}), 'VC', ''))) // 2)"


def ends(suffix: str) -> str:
    return f"length(w) > {len(suffix)} AND w LIKE '%{suffix}'"


def cut(suffix: str) -> tuple[str, str]:
    n = f"(length(w) - {len(suffix)})"
    return f"substr(w, 1, {n})", n


def replaced(rules: str) -> str:
    cases = []
    for rule in rules.split():
        old, new = rule.split(">")
        root, n = cut(old)
        cases.append(f"WHEN {ends(old)} THEN CASE WHEN {measure(n)} > 0 THEN {root} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def dropped() -> str:
    cases = []
    for old in PORTER_4.split():
        root, n = cut(old)
        also = f" AND right({root}, 1) IN ('s', 't')" if old == "ion" else ""
        cases.append(f"WHEN {ends(old)} THEN CASE WHEN {measure(n)} > 1{also} THEN {root} ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


CVC = "(substr(s, {0} - 2, 3) = 'CVC' AND {0} > 2 AND substr(w, {0}, 1) NOT IN ('w', 'x', 'y'))"
PAST = f"""CASE WHEN {ends('eed')} THEN CASE WHEN {measure('length(w) - 3')} > 0 THEN left(w, -1) ELSE w END
  WHEN {ends('ed')} OR {ends('ing')} THEN CASE WHEN NOT regexp_matches(root, '[aeiou]|.y') THEN w
    WHEN regexp_matches(root, '.(at|bl|iz)$') THEN root || 'e'
    WHEN regexp_matches(root, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$') THEN left(root, -1)
    WHEN {measure('length(root)')} = 1 AND {CVC.format('length(root)')} THEN root || 'e' ELSE root END ELSE w END"""
FINAL_E = f"""CASE WHEN w LIKE '%e' AND ({measure('length(w) - 1')} > 1
    OR ({measure('length(w) - 1')} = 1 AND NOT {CVC.format('(length(w) - 1)')})) THEN left(w, -1) ELSE w END"""
FINAL_L = f"CASE WHEN w LIKE '%ll' AND {measure('length(w) - 1')} > 1 THEN left(w, -1) ELSE w END"


def stems(vocabulary: str) -> str:
    """CTEs from ``vocabulary`` (rows of ``raw``) to ``stems`` (``raw, stem``).

    A non-ASCII letter is written twice while stemming: it counts as two
    consonants, as its two bytes do.
    """
    steps = [
        "CASE WHEN w NOT LIKE '%s' OR w LIKE '%ss' THEN w WHEN regexp_matches(w, '.(sses|ies)$') THEN left(w, -2) ELSE left(w, -1) END",
        PAST,
        "CASE WHEN w LIKE '%y' AND regexp_matches(left(w, -1), '[aeiou]|.y') THEN left(w, -1) || 'i' ELSE w END",
        replaced(PORTER_2), replaced(PORTER_3), dropped(), FINAL_E, FINAL_L,
    ]
    ctes = [rf"""stem0 AS (SELECT raw, regexp_replace(raw, '([^\x00-\x7f])', '\1\1', 'g') AS w FROM ({vocabulary})
  WHERE strlen(raw) BETWEEN 3 AND 64)"""]
    for n, step in enumerate(steps):
        ctes.append(f"""stem{n + 1} AS (SELECT raw, {step} AS w FROM (
    SELECT *, {shape("w")} AS s, CASE WHEN w LIKE '%ing' THEN left(w, -3) ELSE left(w, -2) END AS root FROM stem{n}))""")
    ctes.append(rf"""stems AS (SELECT raw, regexp_replace(w, '([^\x00-\x7f])[^\x00-\x7f]', '\1', 'g') AS stem FROM stem{len(steps)}
  UNION ALL SELECT raw, raw FROM ({vocabulary}) WHERE strlen(raw) NOT BETWEEN 3 AND 64)""")
    return ", ".join(ctes)


VOCABULARY = f"SELECT DISTINCT unnest({FOLDED.format('text')}) AS raw FROM documents"


def porter(query: str) -> str:
    words = query.lower().split()
    asked = ", ".join(f"('{q}')" for q in words)
    ctes = stems(f"{VOCABULARY} UNION SELECT col0 FROM (VALUES {asked})")
    counts = ", ".join(f"len(list_filter(ws, lambda t: list_contains(v{i}, t))) AS f{i}" for i in range(len(words)))
    spellings = ", ".join(
        f"(SELECT list(raw) FROM stems WHERE stem = (SELECT stem FROM stems WHERE raw = '{q}')) AS v{i}"
        for i, q in enumerate(words)
    )
    body = bm25_ctes("corpus", [[q] for q in words], "doc_id, source, doc_date", FOLDED.format("text"))
    head, tail = body.split("counted AS (", 1)
    rest = tail.split("totals AS", 1)[1]
    return f"""WITH {CORPUS}, {ctes}, {head}spelled AS (SELECT *, {spellings} FROM words),
counted AS (SELECT doc_id, source, doc_date, len(ws) AS dl, {counts} FROM spelled),
totals AS{rest}
SELECT doc_id, source, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, doc_id LIMIT 50"""


# --- snippets ----------------------------------------------------------------------------


def snippets(word: str) -> str:
    """The best twelve-word window of each top hit of a one-word query."""
    inside = "list_filter(ps, lambda q: q >= {0} AND q < {0} + 12)"
    own, opening = inside.format("p"), inside.format("o")
    return rf"""WITH {CORPUS}, {bm25_ctes("corpus", [[word]], "doc_id, source, doc_date")},
top AS (SELECT doc_id FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 50),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}\p{{Co}}]+') AS ws, regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{Co}}]+') AS gaps,
  regexp_matches(text, '^[\p{{L}}\p{{N}}\p{{Co}}]') AS bare FROM documents WHERE doc_id IN (SELECT doc_id FROM top)),
g AS (SELECT doc_id, text, ws, len(ws) AS n, CASE WHEN bare THEN '' ELSE gaps[1] END AS lead, CASE WHEN bare THEN gaps ELSE gaps[2:] END AS after,
  list_filter(range(len(ws)), lambda i: lower(ws[i + 1]) = '{word}') AS ps FROM t),
s AS (SELECT *, list_filter(range(n), lambda i: i = 0 OR regexp_matches(after[i], '[.:][ \t\n\r]*$')) AS ss FROM g),
c AS (SELECT doc_id, unnest(ps) AS p, ps, ss, n FROM s),
o AS (SELECT *, list_max(list_filter(ss, lambda x: x <= p)) AS o FROM c),
k AS (
  SELECT doc_id, p, 0 AS second, 999 + len({own}) AS score,
    greatest(least({own}[1] - trunc((12 - ({own}[-1] + 1 - {own}[1])) / 2)::BIGINT, n - 12), 0) AS first FROM o
  UNION ALL
  SELECT doc_id, p, 1, CASE WHEN len({opening}) > 0 THEN 999 + len({opening}) ELSE 0 END + CASE WHEN o = 0 THEN 120 ELSE 100 END, o
  FROM o WHERE n > 12 AND o < p),
b AS (SELECT doc_id, first FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, p, second) = 1)
SELECT doc_id, CASE WHEN first > 0 THEN ' ... ' ELSE lead END
  || array_to_string(list_transform(range(first, least(first + 11, n - 1)), lambda i: ws[i + 1] || coalesce(after[i + 1], '')), '')
  || ws[least(first + 12, n)] || CASE WHEN first + 11 >= n - 1 THEN coalesce(after[n], '') ELSE ' ... ' END AS snippet
FROM b JOIN s USING (doc_id)"""


IN_SCOPE = f"source IN ({text_in(w.SOURCES)}) AND doc_date >= '{w.SINCE}' AND doc_date <= '{w.UNTIL}'"


def nearest(query: list[float], name: str, where: str = "true") -> str:
    target = "[" + ", ".join(map(str, query)) + "]::DOUBLE[]"
    return f"""{name} AS (
  SELECT vec_id, d AS distance FROM (
    SELECT vec_id, list_distance(embedding::DOUBLE[], {target}) AS d FROM embeddings WHERE {where})
  ORDER BY round(d, 9), vec_id LIMIT 50)"""


FUSED = f"""{CHUNKS}, {bm25_ctes("chunks", query_phrases(w.QUERY_HYBRID, "simple"), "doc_id, seq")},
l0 AS (SELECT doc_id, seq, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, seq) AS r FROM (
  SELECT * FROM scored ORDER BY round(score, 9) DESC, doc_id, seq LIMIT 50)),
{nearest(w.QUERY_VECTOR, "v1", "label % 2 = 0")}, {nearest(w.CODE_VECTOR, "v2", "label % 2 = 1")},
l1 AS (SELECT vec_id AS doc_id, 0 AS seq, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS r
  FROM v1 WHERE vec_id IN (SELECT doc_id FROM documents)),
l2 AS (SELECT vec_id AS doc_id, 0 AS seq, row_number() OVER (ORDER BY round(distance, 9), vec_id) AS r
  FROM v2 WHERE vec_id IN (SELECT doc_id FROM documents)),
fused AS (SELECT doc_id, seq, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0)
    + coalesce(1.0::DOUBLE / (60 + c.r), 0) AS score
  FROM l0 a FULL JOIN l1 b USING (doc_id, seq) FULL JOIN l2 c USING (doc_id, seq))"""


def squashed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WS_CLASS}+', ' ', 'g'), ' ')"


def excerpt(text: str) -> str:
    flat = squashed(text)
    return f"CASE WHEN length({flat}) <= 200 THEN {flat} ELSE rtrim(substr({flat}, 1, 200), ' ') || ' ...' END"


# --- chunk packing ----------------------------------------------------------------------


def packed(units: str, target: int, overlap: int, joiner: str, head: str = "''") -> str:
    """Greedy packing as a recursive walk over each document's units.

    ``units``: a CTE body giving ``doc_id, prefix, grp, u`` (the unit texts of one
    group as a list). State: first unit of the open run and its joined size.
    """
    j = len(joiner)
    glue = " || ".join(f"chr({ord(c)})" for c in joiner)
    return f"""
groups AS ({units}),
pieces AS (
  SELECT doc_id, prefix, grp,
    flatten(list_transform(u, lambda x: CASE WHEN length(x) > {target}
      THEN list_transform(range(CAST(ceil(length(x) / {target}.0) AS BIGINT)), lambda i: {{'t': substr(x, i * {target} + 1, {target}), 'solo': true}})
      ELSE [{{'t': x, 'solo': false}}] END)) AS p
  FROM groups),
ready AS (SELECT *, len(p) AS np, list_transform(p, lambda x: length(x.t)) AS ls FROM pieces WHERE len(p) > 0),
walk AS (
  SELECT doc_id, grp, 0::BIGINT AS i, 0::BIGINT AS first, 0::BIGINT AS size, -1::BIGINT AS from_u, 0::BIGINT AS n_u FROM ready
  UNION ALL
  SELECT doc_id, grp, i + 1,
    CASE WHEN solo THEN i + 1 WHEN full_up THEN tail ELSE first END,
    CASE WHEN solo THEN 0 WHEN full_up THEN tail_size + l + CASE WHEN tail < i THEN {j} ELSE 0 END
      ELSE size + l + CASE WHEN first < i THEN {j} ELSE 0 END END,
    CASE WHEN (solo OR full_up) AND first < i THEN first ELSE -1 END,
    CASE WHEN (solo OR full_up) AND first < i THEN i - first ELSE 0 END
  FROM (
    SELECT s.*, r.ls[i + 1] AS l, r.p[i + 1].solo AS solo,
      first < i AND size + {j} + r.ls[i + 1] > {target} AS full_up,
      CASE WHEN {overlap} = 0 THEN i ELSE coalesce(list_min(list_filter(range(first, i), lambda k:
        list_sum(r.ls[k + 1:i]) + {j} * (i - 1 - k) <= {overlap})), i - 1) END AS tail,
      CASE WHEN {overlap} = 0 THEN 0 ELSE coalesce(list_sum(r.ls[coalesce(list_min(list_filter(range(first, i), lambda k:
        list_sum(r.ls[k + 1:i]) + {j} * (i - 1 - k) <= {overlap})), i - 1) + 1:i]), 0)
        + {j} * (i - 1 - coalesce(list_min(list_filter(range(first, i), lambda k:
        list_sum(r.ls[k + 1:i]) + {j} * (i - 1 - k) <= {overlap})), i - 1)) END AS tail_size
    FROM walk s JOIN ready r USING (doc_id, grp) WHERE i < r.np)),
runs AS (
  SELECT doc_id, grp, from_u AS first, n_u AS n, i AS ord, 0 AS half FROM walk WHERE from_u >= 0
  UNION ALL
  SELECT doc_id, grp, k, 1, k + 1, 1 FROM (SELECT doc_id, grp, unnest(range(np)) AS k, p FROM ready) WHERE p[k + 1].solo
  UNION ALL
  SELECT s.doc_id, s.grp, s.first, r.np - s.first, r.np + 1, 0 FROM walk s JOIN ready r USING (doc_id, grp)
  WHERE s.i = r.np AND s.first < r.np)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, ord, half) - 1 AS seq,
  sha256(prefix || {head} || array_to_string(list_transform(p[first + 1:first + n], lambda x: x.t), {glue})) AS text_hash
FROM runs JOIN ready USING (doc_id, grp)"""


PREFIX = f"source || '/' || path || {NL} || {NL}"
STRIPPED_LIST = "list_filter(list_transform({0}, lambda x: trim(x, " + BLANKS + ")), lambda x: x <> '')"


def split_lines(text: str) -> str:
    return f"string_split({text}, {NL})"


CHUNK_PARAGRAPHS = f"WITH RECURSIVE {CORPUS}, " + packed(
    f"SELECT doc_id, {PREFIX} AS prefix, 0 AS grp, {STRIPPED_LIST.format(split_lines('text'))} AS u FROM corpus",
    1000, 160, "\n\n",
)
# A heading opens a group; a document's first group is whatever precedes it.
CHUNK_MARKDOWN = f"WITH RECURSIVE {CORPUS}, " + packed(
    f"""SELECT doc_id, prefix, grp, {STRIPPED_LIST.format(split_lines("sec"))} AS u FROM (
    SELECT doc_id, {PREFIX} AS prefix, unnest(secs) AS sec, generate_subscripts(secs, 1) AS grp FROM (
      SELECT *, string_split(regexp_replace(trim(text, {BLANKS}), '\\n([A-F])', chr(1) || '## \\1', 'g'), chr(1)) AS secs FROM corpus))""",
    1000, 160, "\n\n",
)
CHUNK_CSV = f"WITH RECURSIVE {CORPUS}, lines AS (SELECT *, {split_lines(f'trim(text, {NL})')} AS ls FROM corpus), " + packed(
    f"""SELECT doc_id, {PREFIX} || ls[1] || CASE WHEN len(rows) > 0 THEN {NL} ELSE '' END AS prefix, 0 AS grp,
    CASE WHEN len(rows) > 0 THEN rows ELSE [''] END AS u FROM (
    SELECT *, list_filter(ls[2:], lambda x: x <> '') AS rows FROM lines) WHERE ls[1] <> ''""",
    1000, 160, "\n",
)
# A block: one line plus the indented ones after it. Longer ones fall back to paragraphs, of which there is one.
CHUNK_CODE = f"WITH RECURSIVE {CORPUS}, " + packed(
    f"""SELECT doc_id, prefix, 0 AS grp,
    list_transform(u, lambda x: CASE WHEN length(x) > 1000 AND trim(x, {BLANKS}) <> '' THEN trim(x, {BLANKS}) ELSE x END) AS u FROM (
    SELECT doc_id, {PREFIX} AS prefix,
    string_split(regexp_replace(regexp_replace(trim(regexp_replace(text, '\\. ', '.' || {NL} || '    ', 'g'), {NL}),
      '\\n([^\\s{WS_IN_LINE_CLASS[1:]})', chr(1) || '\\1', 'g'), '^', ''), chr(1)) AS u FROM corpus)""",
    1000, 0, "\n\n",
)

# Every layout in one pass: notes (no heading among them), tables, code and commits.
CHUNK_ROUTED = " UNION ALL ".join([
    f"SELECT * FROM (WITH RECURSIVE {ROUTED}, " + packed(
        f"SELECT doc_id, {PREFIX} AS prefix, 0 AS grp, [trim(text, {BLANKS})] AS u FROM routed WHERE doc_id % 6 IN (0, 1, 4)",
        4000, 400, "\n\n") + ")",
    f"SELECT * FROM (WITH RECURSIVE {ROUTED}, lines AS (SELECT *, {split_lines(f'trim(text, {NL})')} AS ls FROM routed WHERE doc_id % 6 = 3), " + packed(
        f"""SELECT doc_id, {PREFIX} || ls[1] || CASE WHEN len(rows) > 0 THEN {NL} ELSE '' END AS prefix, 0 AS grp,
        CASE WHEN len(rows) > 0 THEN rows ELSE [''] END AS u FROM (
        SELECT *, list_filter(ls[2:], lambda x: x <> '') AS rows FROM lines) WHERE ls[1] <> ''""", 4000, 400, "\n") + ")",
    f"SELECT * FROM (WITH RECURSIVE {ROUTED}, " + packed(
        f"""SELECT doc_id, prefix, 0 AS grp, list_transform(u, lambda x: CASE WHEN length(x) > 6000 AND trim(x, {BLANKS}) <> '' THEN trim(x, {BLANKS}) ELSE x END) AS u FROM (
        SELECT doc_id, {PREFIX} AS prefix, string_split(regexp_replace(trim(text, {NL}), '\\n([^\\s{WS_IN_LINE_CLASS[1:]})', chr(1) || '\\1', 'g'), chr(1)) AS u
        FROM routed WHERE doc_id % 6 = 2)""", 6000, 0, "\n\n") + ")",
    f"""SELECT * FROM (WITH {ROUTED} SELECT doc_id, 0::BIGINT AS seq,
      sha256(source || ' ' || substr(path, 8, 7) || '  ' || substr(doc_date, 1, 10) || {NL} || {NL} || trim(text, {BLANKS})) AS text_hash
      FROM routed WHERE path LIKE 'commit/%')""",
])

SNAPSHOTS = f"""{ROUTED},
probes AS (
  SELECT source, path,
    CASE WHEN path NOT LIKE 'commit/%' THEN (doc_id * 1000) || ':' || length(text) || CASE WHEN doc_id % 4 = 0 THEN '0' ELSE '' END END AS stat_sig,
    CASE WHEN path LIKE 'commit/%' THEN CASE WHEN doc_id % 9 = 0 THEN reverse(sha256(text)) ELSE sha256(text) END END AS git_sha
  FROM routed WHERE doc_id % 10 <> 3),
stored AS (
  SELECT doc_id, source, path, CASE WHEN path NOT LIKE 'commit/%' THEN (doc_id * 1000) || ':' || length(text) END AS stat_sig,
    sha256(text) AS content_hash FROM routed WHERE doc_id % 7 <> 2),
changes AS (
  SELECT source, path, s.doc_id, CASE WHEN s.source IS NULL THEN 'added' WHEN p.source IS NULL THEN 'deleted'
    WHEN p.stat_sig = s.stat_sig OR (p.stat_sig IS NULL AND p.git_sha = s.content_hash) THEN 'unchanged' ELSE 'changed' END AS change
  FROM (SELECT *, source AS src FROM probes) p FULL JOIN stored s USING (source, path))""".replace(
    "WHEN s.source IS NULL", "WHEN s.doc_id IS NULL").replace("WHEN p.source IS NULL", "WHEN p.src IS NULL")

EXT = r"lower(regexp_extract(path, '[^/](\.[^./]+)$', 1))"
KIND = f"CASE WHEN path NOT LIKE 'commit/%' AND {EXT} IN ({text_in(CODE_SUFFIXES)}) THEN 'code' ELSE 'prose' END"


def embed_rule() -> str:
    parts = []
    for name, globs in w.EMBED_RULES.items():
        out = "".join(f" AND path NOT LIKE '{g.replace('*', '%')}'" for g in globs)
        parts.append(f"(source = '{name}'{out})")
    return " OR ".join(parts)


QUEUE = f"""{ROUTED}, {prose_chunks("routed")}, queue AS (
  SELECT doc_id, seq, source, {KIND} AS kind, length(text) // 4 AS tokens FROM chunks c
  WHERE ({embed_rule()}) AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.doc_id AND c.seq = 0))"""

KIND_COST = " ".join(f"WHEN '{k}' THEN {PRICE_PER_MILLION[m]}" for k, m in w.MODELS.items())


def html_text() -> str:
    tags = "p|div|br|hr|li|tr|table|ul|ol|h1|h2|h3|h4|h5|h6|blockquote|pre|section|article|header|footer"
    x = r"regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g')"
    x = rf"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?({tags})(\s[^>]*)?/?>', chr(10), 'g')"
    x = rf"regexp_replace({x}, '<[!/a-zA-Z][^>]*>', '', 'g')"
    # These names also count without their semicolon, as where a title was cut short.
    for entity, char in (("quot", "chr(34)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("lt", "chr(60)"), ("gt", "chr(62)"), ("amp", "chr(38)")):
        x = f"regexp_replace({x}, '&{entity};?', {char}, 'g')"
    x = rf"regexp_replace({x}, '[ \t\r\f\v]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '{WS_IN_LINE_CLASS}*\n{WS_IN_LINE_CLASS}*', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, trim({x}, {BLANKS}) AS text FROM pages"


def quoted() -> str:
    body = rf"""CASE WHEN prev IS NULL THEN text
      WHEN turn % 3 = 2 THEN text || {NL} || {NL} || {NL} || {NL} || quote || {NL} || {NL} || 'regards'
      ELSE text || {NL} || {NL} || 'On ' || turn || ' May 2024, someone WROTE:' || {NL} || {NL} || quote END"""
    cut = rf"regexp_replace(body, '(?im)^{WS_CLASS}*On{WS_CLASS}.{{0,200}}?wrote:{WS_CLASS}*$(?s:.*)', '')"
    kept = f"list_filter(string_split({cut}, {NL}), lambda x: NOT starts_with(ltrim(x, {BLANKS}), '>'))"
    joined = rf"regexp_replace(array_to_string({kept}, {NL}), '\n{{3,}}', {NL} || {NL}, 'g')"
    return rf"""WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
q AS (SELECT *, '> ' || replace(prev, {NL}, {NL} || '> ') AS quote FROM t),
b AS (SELECT conv_id, turn, {body} AS body FROM q)
SELECT conv_id, turn, trim({joined}, {BLANKS}) AS body FROM b"""


def slugged(name: str) -> str:
    return rf"lower({squashed(rf'regexp_replace({name}, {chr(39)}[^\p{{L}}\p{{N}}_{WS_CLASS[1:]}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


SEED_ROWS = ", ".join(
    f"('{kind}', '{name}')" for kind, names in (("person", w.SEEDS.persons), ("org", w.SEEDS.orgs)) for name in names
)
# The stored index at the end: one document a row, under the paths of one source.
FINAL = f"""final AS (
  SELECT doc_id, 'corpus' AS source, source || '/' || doc_id || '.txt' AS path, {DOC_DATE} AS doc_date, text
  FROM documents WHERE coalesce(lang, '') <> '{w.DELETED_LANG}'),
{prose_chunks("final", "final_chunks")}"""

DRAFTS = f"""drafts AS (
  SELECT doc_id, 'corpus' AS source, source || '/' || doc_id || '.txt' AS path,
    CASE WHEN lang = '{w.CHANGED_LANG}' THEN substr(text, 1, {w.DRAFT_CHARS}) ELSE text END AS text
  FROM documents WHERE coalesce(lang, '') <> '{w.ADDED_LANG}'),
{prose_chunks("drafts", "draft_chunks")}"""


def indexed_scores(query: str) -> str:
    """BM25 over stems for all chunks of the final documents."""
    words = query.lower().split()
    vocabulary = f"SELECT DISTINCT unnest({FOLDED.format('text')}) AS raw FROM final_chunks"
    ctes = stems(f"{vocabulary} UNION SELECT col0 FROM (VALUES {', '.join(f'({chr(39)}{q}{chr(39)})' for q in words)})")
    counts = ", ".join(f"len(list_filter(ws, lambda t: list_contains(v{i}, t))) AS f{i}" for i in range(len(words)))
    spellings = ", ".join(
        f"(SELECT list(raw) FROM stems WHERE stem = (SELECT stem FROM stems WHERE raw = '{q}')) AS v{i}" for i, q in enumerate(words))
    head, tail = bm25_ctes("final_chunks", [[q] for q in words], "path, seq", FOLDED.format("text")).split("counted AS (", 1)
    return f"""WITH {FINAL}, {ctes}, {head}spelled AS (SELECT *, {spellings} FROM words),
counted AS (SELECT path, seq, len(ws) AS dl, {counts} FROM spelled),
totals AS{tail.split("totals AS", 1)[1]}
SELECT path, seq, round(score, 6) AS score FROM scored"""


def path_entities() -> str:
    """Folders and seed names of the final paths. The first spelling of an entity by path names it."""
    seeds = ", ".join(f"('{kind}', '{n}')" for kind, ns in (("person", w.INDEX_SEEDS.persons), ("org", w.INDEX_SEEDS.orgs)) for n in ns)
    return f"""WITH {FINAL}, seeds(kind, name) AS (VALUES {seeds}),
found AS (
  SELECT path, 'category' AS kind, split_part(path, '/', 1) AS key, 'category' AS rel, split_part(path, '/', 1) AS display FROM final
  UNION ALL SELECT path, kind, {slugged("name")}, 'mentions', name FROM final JOIN seeds
    ON contains(lower(split_part(path, '/', -1) || chr(10) || path), lower(name)))
SELECT kind, key, rel, any_value(display) AS display, count(DISTINCT path) AS documents FROM found GROUP BY kind, key, rel"""


CARD_PERSON = "person no 5"

ORACLE = {
    "hybrid_search": f"""WITH {FUSED},
best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) = 1)
SELECT source, path, doc_date, round(best.score, 6) AS score, {excerpt("text")} AS excerpt, seq AS chunk_seq
FROM best JOIN chunks USING (doc_id, seq) ORDER BY best.score DESC, source, path LIMIT 10""",
    "lexical_bm25": lexical(w.QUERY_ONE),
    "lexical_bm25_filtered": lexical(w.QUERY_COMMON, IN_SCOPE),
    "lexical_multi_term_and": lexical(w.QUERY_AND),
    "lexical_phrase_bm25": lexical(w.QUERY_PHRASE),
    "porter_bm25": porter(w.QUERY_STEMS),
    "porter_stems": f"WITH {stems(VOCABULARY)} SELECT raw AS word, stem FROM stems",
    "lexical_snippets": snippets(w.QUERY_ONE),
    "indexed_bm25": f"""WITH {CHUNKS}, {bm25_ctes("chunks", query_phrases(w.QUERY_AND, "simple"), "doc_id, seq")}
SELECT doc_id, seq, round(score, 6) AS score FROM scored ORDER BY round(scored.score, 9) DESC, doc_id, seq LIMIT 50""",
    "phrase_match": f"""WITH m AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
c AS (SELECT doc_id, {phrase_count("ws", ["of", "the"])} AS tf_phrase, {phrase_count("ws", ["thon"])} AS tf_word FROM m)
SELECT * FROM c WHERE tf_phrase > 0 AND tf_word > 0""",
    "postings": f"""WITH m AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term, generate_subscripts(ws, 1) - 1 AS p FROM m)
SELECT doc_id, term, count(*) AS tf, dl, min(p) AS first_position FROM t GROUP BY doc_id, term, dl""",
    "term_frequencies": f"""WITH t AS (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""",
    "corpus_stats": f"""SELECT count(*) AS n, CAST(sum(len(ws)) AS BIGINT) AS words, round(avg(len(ws)), 6) AS avgdl
FROM (SELECT {WORDS.format("text")} AS ws FROM documents)""",
    "knn_top50": f"WITH {nearest(w.QUERY_VECTOR, 'v')} SELECT vec_id, round(distance, 6) AS distance FROM v",
    "knn_postfilter": f"""WITH {CORPUS}, {nearest(w.QUERY_VECTOR, "v")}
SELECT doc_id, source, round(distance, 6) AS distance FROM v JOIN corpus ON doc_id = vec_id WHERE doc_date <= '{w.UNTIL}'""",
    "rrf_three_lists": f"WITH {FUSED} SELECT doc_id, seq, round(score, 6) AS score FROM fused",
    "best_chunk_per_doc": f"""WITH {CHUNKS}, {bm25_ctes("chunks", query_phrases(w.QUERY_COMMON, "simple"), "doc_id, seq")}
SELECT doc_id, seq, round(score, 6) AS score FROM (SELECT doc_id, seq, round(score, 9) AS score FROM scored)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seq) = 1""",
    "source_date_filter": f"WITH {CORPUS} SELECT doc_id, source, doc_date FROM corpus WHERE {IN_SCOPE}",
    "window_excerpt": f"SELECT doc_id, {excerpt('text')} AS excerpt FROM documents",
    "chunk_prose": f"WITH {CHUNKS} SELECT doc_id, seq, sha256(text) AS text_hash FROM chunks",
    "chunk_paragraphs": CHUNK_PARAGRAPHS,
    "chunk_markdown": CHUNK_MARKDOWN,
    "chunk_csv": CHUNK_CSV,
    "chunk_code": CHUNK_CODE,
    "chunk_routed": CHUNK_ROUTED,
    "chunk_whole": f"""WITH {CORPUS} SELECT doc_id, 0::BIGINT AS seq,
sha256(source || ' ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 7) || '  ' || substr(doc_date, 1, 10) || {NL} || {NL} || trim(text, {BLANKS})) AS text_hash
FROM corpus""",
    "doc_reconstruct": f"""WITH {CHUNKS} SELECT doc_id, sha256(string_agg(text, {NL} || {NL} ORDER BY seq)) AS content_hash
FROM chunks GROUP BY doc_id""",
    "doc_truncate": "SELECT doc_id, sha256(substr(text, 1, 2000)) AS content_hash, length(text) > 2000 AS truncated FROM documents",
    "html_to_text": html_text(),
    "quoted_strip": quoted(),
    "content_gate": f"""WITH {ROUTED} SELECT doc_id, {EXT} AS suffix,
CASE WHEN {EXT} IN ({text_in(TEXT_SUFFIXES + CODE_SUFFIXES)}) THEN 'decode' WHEN {EXT} IN ({text_in(CONVERT_SUFFIXES)}) THEN 'convert' ELSE 'metadata' END AS handling,
{KIND} AS kind,
CASE WHEN path LIKE 'commit/%' THEN 'whole' WHEN {EXT} IN ({text_in(CODE_SUFFIXES)}) THEN 'code' WHEN {EXT} = '.csv' THEN 'csv' WHEN {EXT} = '.md' THEN 'markdown' ELSE 'prose' END AS layout,
sha256(text) AS content_hash, strlen(text) AS bytes, contains(substr(text, 1, 8192), chr(0)) AS is_binary, length(text) // 4 AS tokens
FROM routed""",
    "decode_fallback": r"SELECT doc_id, sha256(regexp_replace(text, '[^\x{1}-\x{ff}]', '?', 'g')) AS text_hash FROM documents",
    "decode_charsets": r"""SELECT doc_id, sha256(translate(regexp_replace(text, '[^\x{1}-\x{ff}]', '?', 'g'), 'éèü',
  CASE lang WHEN 'fr' THEN 'œ€' || chr(128) WHEN 'de' THEN '½¤€' ELSE '½¤' || chr(128) END)) AS text_hash FROM documents""",
    "mail_headers": f"""WITH {MAIL} SELECT doc_id, title || ' — ' || sender || ', ' || substr(doc_date, 1, 10) AS header,
sha256('From: ' || sender || {NL} || coalesce('To: ' || receivers || {NL}, '') || 'Subject: ' || title || {NL} || 'Date: ' || doc_date
  || {NL} || 'Labels: INBOX, P' || regexp_extract(title, '[^ ]*$')) AS block_hash FROM mail""",
    "email_occurrences": f"WITH {FOUND} SELECT doc_id, key, rel, display, n FROM found",
    "address_items": """WITH c AS (SELECT c_custkey AS doc_id, c_name, c_mktsegment AS seg, lower(c_mktsegment) AS low,
  replace(c_name, '#', '.') || '@' || lower(c_mktsegment) || '.example.com' AS mailbox FROM customer)
SELECT doc_id, lower(mailbox) AS key, c_name AS display, 0::BIGINT AS n FROM c
UNION ALL SELECT doc_id, 'a.' || lower(mailbox), 'a.' || mailbox, 1 FROM c
UNION ALL SELECT doc_id, 'desk@' || low || '.example.com', seg || ', desk', 2 FROM c""",
    "document_edges": f"WITH {FOUND} SELECT DISTINCT doc_id, kind, key, rel FROM found",
    "display_most_frequent": f"WITH {FOUND}, {VOTES} SELECT 'email' AS kind, key, display FROM shown",
    "slug_normalize": f"""SELECT name, {slugged("name")} AS slug FROM (
SELECT c_name || '  (' || c_mktsegment || ')' AS name FROM customer
UNION ALL SELECT p_brand || ' / ' || p_name || ' / ' || p_type FROM part)""",
    "category_from_path": rf"""WITH p AS (SELECT page_id AS doc_id, regexp_extract(url, '^[^/]*//[^/]*/(.*)$', 1) AS path FROM pages)
SELECT doc_id, {slugged("display")} AS key, display FROM (SELECT doc_id, trim(string_split(path, '/')[1], {BLANKS}) AS display FROM p WHERE contains(path, '/')) WHERE display <> ''""",
    "mentions": f"""WITH {MAIL}, seeds(kind, name) AS (VALUES {SEED_ROWS})
SELECT doc_id, kind, {slugged("name")} AS key, name AS display FROM mail, seeds
WHERE contains(lower(title || ' ' || sender || {NL} || path), lower(trim(name)))""",
    "entity_links": f"WITH {GRAPH} SELECT a_kind || ':' || a_key AS a, rel, b_kind || ':' || b_key AS b FROM links",
    "entity_lookup": f"""WITH {GRAPH} SELECT DISTINCT b_kind AS kind, b_key AS key, b_display AS display FROM links WHERE b_key = '{CARD_PERSON}'""",
    "entity_card_links": f"""WITH {GRAPH}, {VOTES}
SELECT 'out' AS direction, rel, b_kind AS kind, b_key AS key, b_display AS display FROM links WHERE a_kind = 'person' AND a_key = '{CARD_PERSON}'
UNION ALL SELECT 'in', rel, a_kind, a_key, display FROM links JOIN shown ON key = a_key WHERE b_kind = 'person' AND b_key = '{CARD_PERSON}'""",
    "entity_neighbours": f"""WITH {GRAPH}, {VOTES}
SELECT rel, b_kind AS kind, b_key AS key, b_display AS display FROM links WHERE a_kind = 'person' AND a_key = '{CARD_PERSON}'
UNION ALL SELECT rel, a_kind, a_key, display FROM links JOIN shown ON key = a_key WHERE b_kind = 'person' AND b_key = '{CARD_PERSON}'""",
    "entity_card_documents": f"""WITH {FOUND} SELECT DISTINCT m.source, m.path, title, doc_date, rel FROM found f JOIN mail m USING (doc_id)
WHERE key = '{w.CARD_ENTITY[1]}' ORDER BY doc_date DESC, m.source, m.path, rel LIMIT 20""",
    "alias_review": rf"""WITH {FOUND}, every AS (
  SELECT doc_id, source, path, rel, n, key, display FROM found
  UNION ALL SELECT doc_id, 'repo', path, 'author', 0, key, display FROM found WHERE rel = 'from' AND doc_id % 5 = 0),
{VOTES.replace("FROM found", "FROM every")},
top AS (SELECT key, count(DISTINCT doc_id) AS n FROM every WHERE rel IN ('from', 'to', 'cc') GROUP BY key ORDER BY n DESC, key LIMIT {w.TOP_N}),
authors AS (SELECT key, count(DISTINCT doc_id) AS n FROM every WHERE rel = 'author' GROUP BY key)
SELECT key, display, coalesce(t.n, a.n) AS n,
  CASE WHEN a.n IS NULL THEN 'correspondent' WHEN t.n IS NULL THEN 'git author' ELSE 'correspondent+git author' END AS tags
FROM top t FULL JOIN authors a USING (key) JOIN shown USING (key)""",
    "snapshot_diff": f"WITH {SNAPSHOTS} SELECT source, path, change FROM changes",
    "change_counts": f"""WITH {SNAPSHOTS} SELECT source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'unchanged') AS unchanged FROM changes GROUP BY source""",
    "delete_cascade": f"""WITH {SNAPSHOTS}, {CORPUS}, {prose_chunks("corpus")}
SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks
WHERE doc_id NOT IN (SELECT doc_id FROM changes WHERE change = 'deleted') GROUP BY doc_id""",
    "embed_eligible": f"WITH {QUEUE} SELECT doc_id, seq, kind, tokens FROM queue",
    "embed_plan": f"""WITH {QUEUE}, costs AS (
  SELECT source, kind, count(*) AS chunks, sum(tokens) AS tokens, sum(tokens) * (CASE kind {KIND_COST} END)::DOUBLE / 1000000 AS cost FROM queue GROUP BY 1, 2)
SELECT source, kind, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost_usd
FROM costs GROUP BY GROUPING SETS ((source, kind), (kind), ())""",
    "stats_per_source": f"""WITH {CHUNKS}, listed(source) AS (VALUES {", ".join(f"('src{i}')" for i in range(0, 24, 2))}),
per AS (SELECT d.source, d.doc_id, count(c.doc_id) AS n, count(l.doc_id) AS e FROM documents d LEFT JOIN chunks c ON c.doc_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = c.doc_id AND c.seq = 0 GROUP BY 1, 2)
SELECT source, count(doc_id) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(e), 0) AS BIGINT) AS embedded
FROM listed LEFT JOIN per USING (source) GROUP BY source""",
    "mentions_of_all": f"""WITH {MAIL}, names AS (SELECT 'person' AS kind, c_name AS name FROM customer UNION ALL SELECT 'org', s_name FROM supplier)
SELECT doc_id, kind, {slugged("name")} AS key, name AS display FROM mail JOIN names
ON contains(lower(concat_ws(' ', title, sender, receivers)), lower(name))""",
    "index_updates": f"""WITH {FINAL}, {DRAFTS}, both_versions AS (
  SELECT coalesce(d.path, f.path) AS path, d.path IS NULL AS added, f.path IS NULL AS deleted, coalesce(d.text <> f.text, false) AS changed
  FROM drafts d FULL JOIN final f ON f.path = d.path)
SELECT 1 AS step, count(*) AS added, 0 AS changed, 0 AS deleted, 0 AS unchanged, (SELECT count(*) FROM draft_chunks) AS chunks FROM drafts
UNION ALL SELECT 2, count(*) FILTER (added), count(*) FILTER (changed), count(*) FILTER (deleted), count(*) FILTER (NOT added AND NOT changed AND NOT deleted),
  (SELECT count(*) FROM final_chunks c JOIN both_versions b ON b.path = c.path WHERE added OR changed) FROM both_versions""",
    "index_documents": f"""WITH {FINAL} SELECT path, doc_id || '.txt' AS title, doc_date, CAST(strlen(text) AS BIGINT) AS bytes,
sha256(text) AS content_hash, sha256(text) AS text_hash FROM final""",
    "index_chunks": f"""WITH {FINAL} SELECT path, seq, CAST(len({FOLDED.format("text")}) AS BIGINT) AS words, sha256(text) AS text_hash FROM final_chunks""",
    "index_terms": f"""WITH {FINAL}, {stems(f"SELECT DISTINCT unnest({FOLDED.format('text')}) AS raw FROM final_chunks")},
said AS (SELECT path, seq, unnest({FOLDED.format("text")}) AS raw FROM final_chunks)
SELECT stem AS term, count(DISTINCT (path, seq)) AS df, count(*) AS cf FROM said JOIN stems USING (raw) GROUP BY stem""",
    "index_bm25": indexed_scores(w.QUERY_STEMS),
    "index_entities": path_entities(),
    "index_vectors": f"""WITH {FINAL} SELECT path, seq, 'prose' AS kind, CAST(length(text) // 4 AS BIGINT) AS tokens,
CAST(length(regexp_replace(text, '[^a-z]', '', 'g')) AS DOUBLE) AS letters FROM final_chunks
WHERE path NOT LIKE 'src3/%' AND path NOT LIKE 'src1%/%7.txt'""",
}
