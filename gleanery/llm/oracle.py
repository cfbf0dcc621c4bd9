"""SQL for the training-data queries that SQL can express, over whole tables and whole texts."""

from __future__ import annotations

from gleanery.llm.quality import ALPHA, DELTA, GRIDS

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

EXACT = f"""WITH folded AS (SELECT doc_id, {FOLDED} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(body) AS text_sha256 FROM folded WINDOW g AS (PARTITION BY body)"""


def quality() -> str:
    """The counts, then the exact binomial test of every cutoff, by the closed form of each term."""
    cuts = ", ".join(
        f"({r}, '{rule}', {i}, CAST({cut} AS DOUBLE))"
        for r, (rule, grid) in enumerate(GRIDS.items()) for i, cut in enumerate(grid))
    return rf"""WITH docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS body,
    {WORDS.format("coalesce(text, '')")} AS words,
    [line FOR line IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(line, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, piece) AS n FROM (
    SELECT doc_id, pos, array_to_string(words[pos:pos + 4], ' ') AS piece
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS pos FROM docs))),
repeated AS (
  SELECT doc_id, count(DISTINCT pos + step) AS n FROM windows, range(5) AS steps(step) WHERE n > 1 GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(translate(body, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(body) - length(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper
  FROM docs d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
rates AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
measured AS (
  SELECT doc_id, stratum, base_failed, unnest([
    {{'rule': 'symbols_per_word', 'value': n_symbols / greatest(n_words, 1)}},
    {{'rule': 'dup_line_share', 'value': n_dup_lines / greatest(n_lines, 1)}},
    {{'rule': 'repeat_share', 'value': n_repeat_words / greatest(n_words, 1)}},
    {{'rule': 'mean_word_chars', 'value': word_chars / greatest(n_words, 1)}},
    {{'rule': 'upper_share', 'value': n_upper / greatest(word_chars, 1)}}], recursive := true) FROM rates),
cuts(place, rule, step, cut) AS (VALUES {cuts}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
tested AS (
  SELECT stratum, c.rule, step, cut, count(*) AS n, count(*) FILTER (WHERE value > cut) AS k
  FROM measured m JOIN good USING (doc_id) JOIN cuts c ON c.rule = m.rule
  WHERE NOT base_failed GROUP BY ALL),
tails AS (
  SELECT stratum, rule, step, cut, k < n * {ALPHA} AND sum(exp(
    lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
    <= {DELTA} / ({len(GRIDS)} * (SELECT count(DISTINCT stratum) FROM tested)) AS accepted
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM tested) GROUP BY stratum, rule, step, cut, n, k),
chosen AS (
  SELECT stratum, rule, min(cut) AS cut FROM tails t WHERE NOT EXISTS (
    SELECT 1 FROM tails f WHERE f.stratum = t.stratum AND f.rule = t.rule AND f.step <= t.step AND NOT f.accepted)
  GROUP BY stratum, rule),
broken AS (
  SELECT doc_id, arg_min(m.rule, place) AS rule FROM measured m
  JOIN chosen c ON c.stratum = m.stratum AND c.rule = m.rule
  JOIN (SELECT DISTINCT rule, place FROM cuts) o ON o.rule = m.rule
  WHERE NOT base_failed AND value > c.cut GROUP BY doc_id)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND b.rule IS NULL AS kept, b.rule AS rejected_by
FROM rates r LEFT JOIN broken b ON b.doc_id = r.doc_id"""


NEAR = rf"""WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(FOLDED)} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 4], ' ') AS piece
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.piece = b.piece
  WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


WARC = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
newest AS (
  SELECT *, CASE WHEN strlen(body) >= 1000 THEN nullif(max(page_id) OVER (PARTITION BY body), page_id) END AS refers_to FROM payloads)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM newest"""


# Bytes are pairs of hex digits here.
REPEATS = """WITH docs AS (SELECT doc_id, hex(coalesce(text, '')) AS body FROM documents),
starts AS (
  SELECT doc_id, pos, substring(body, 2 * pos + 1, 100) AS piece
  FROM (SELECT doc_id, body, unnest(range(0, length(body) // 2 - 49)) AS pos FROM docs)),
known AS (SELECT piece, min(doc_id) AS lowest FROM starts GROUP BY piece HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT s.doc_id, pos FROM starts s JOIN known k ON k.piece = s.piece WHERE s.doc_id > lowest),
islands AS (
  SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (
    SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM gone)),
spans AS (SELECT doc_id, min(pos) AS lo, max(pos) + 50 AS hi FROM islands GROUP BY doc_id, island),
pieces AS (
  SELECT s.doc_id, lo, hi, substring(body, 2 * before + 1, 2 * (lo - before)) AS piece
  FROM (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans) s
  JOIN docs d ON d.doc_id = s.doc_id),
left_over AS (
  SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, max(hi) AS reach, string_agg(piece, '' ORDER BY lo) AS head
  FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(length(body) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substring(body, 2 * coalesce(reach, 0) + 1))) AS kept_sha256
FROM docs d LEFT JOIN left_over l ON l.doc_id = d.doc_id"""


# The checksum is computed byte by byte; words meet on what one deleted code point leaves.
VARIANTS = rf"""WITH RECURSIVE steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)
    ORDER BY i) AS step FROM range(256) AS r(i)),
runs AS (
  SELECT CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR) AS doc,
    unnest(regexp_extract_all({FOLDED}, '[a-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) AS run FROM documents),
hexed AS (SELECT run, hex(encode(doc || ':' || run)) AS bytes FROM runs),
summed AS (
  SELECT run, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substring(bytes, i, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM hexed, steps),
words AS (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT word, pos, left(word, pos - 1) || substring(word, pos + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest),
ranked AS (
  SELECT e.word, near, w.n, row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, near) AS place, count(*) OVER (PARTITION BY e.word) AS n_near
  FROM near e JOIN words w ON w.word = e.near),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 10 * w.n THEN near END AS form, CASE WHEN r.n >= 10 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
paths(word, root) AS (
  SELECT word, word FROM judged UNION ALL SELECT p.word, j.form FROM paths p JOIN judged j ON j.word = p.root WHERE form IS NOT NULL)
SELECT j.word, form, p.root, n, n_near, form_n FROM judged j JOIN paths p ON p.word = j.word
WHERE p.root NOT IN (SELECT word FROM judged WHERE form IS NOT NULL)"""


def collocations() -> str:
    """Occurrences by position within pieces; numbers as 128-bit integers where products may be large."""
    lengths = " UNION ALL ".join(
        f"SELECT lang, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase, {k} AS k FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM pieces)"
        for k in range(1, 5))
    return rf"""WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS (SELECT lang, phrase, k, count(*) AS f FROM ({lengths}) GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, phrase, k, f, string_split(phrase, ' ') AS ws FROM counts WHERE k > 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, max(f) AS longer
  FROM candidates c, range(2, 4) AS s(size), range(1, 4) AS p(i) WHERE size < k AND i + size - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_phrases i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(f AS HUGEINT)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, cut,
    CAST(CAST(2000000 AS HUGEINT) * c.f // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM kept c, range(1, 4) AS q(cut), counts x, counts y
  WHERE cut < c.k AND x.lang = c.lang AND y.lang = c.lang
    AND x.phrase = array_to_string(ws[:cut], ' ') AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000"""


ORACLE: dict[str, str] = {
    "op1_exact_dedup": EXACT,
    "op2_quality_rules": quality(),
    "op6_near_dedup": NEAR,
    "op7_warc": WARC,
    "op10_repeated_passages": REPEATS,
    "op11_spelling_variants": VARIANTS,
    "op13_collocations": collocations(),
}
