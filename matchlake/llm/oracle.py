"""DuckDB SQL for the rows of the operators that SQL can express; the queries' parameters are written out."""

from __future__ import annotations

from matchlake.llm import fingerprints, licenses

_REACHED = """
, ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (SELECT u, v FROM ways UNION SELECT r.u, b.v FROM reach r JOIN ways b ON r.v = b.u),
tops AS (SELECT u AS id, least(u, min(v)) AS top FROM reach GROUP BY u)
"""

NEAR_DUPS = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM worded
), classes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), entries AS (SELECT id, n, unnest(s) AS v FROM classes
), shared AS (SELECT *, count(*) OVER (PARTITION BY v) AS times FROM entries
), met AS (
  SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common
  FROM (SELECT * FROM shared WHERE times > 1) a JOIN (SELECT * FROM shared WHERE times > 1) b ON a.v = b.v AND a.id < b.id
  GROUP BY a.id, b.id
), links AS (SELECT a, b FROM met WHERE 100 * common >= 85 * (na + nb - common)
){_REACHED}, member AS (
  SELECT x.doc_id, len(x.s) AS n, c.id FROM (SELECT doc_id, list_sort(s) AS s FROM sets) x LEFT JOIN classes c ON x.s = c.s
)
SELECT doc_id, n AS n_shingles, coalesce(top, id, doc_id) AS component_id, doc_id = coalesce(top, id, doc_id) AS kept
FROM member LEFT JOIN tops USING (id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE x AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings
), live AS (SELECT * FROM x WHERE n > 0 AND isfinite(n)
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM live a JOIN live b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
){_REACHED}, counts AS (SELECT u AS id, count(*) AS n FROM ways GROUP BY u)
SELECT vec_id, coalesce(counts.n, 0) AS n_links, coalesce(top, vec_id) AS component_id, vec_id = coalesce(top, vec_id) AS kept
FROM x LEFT JOIN tops ON tops.id = vec_id LEFT JOIN counts ON counts.id = vec_id
"""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(1) || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
), filling AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), plan AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE),
           weight * (SELECT arg_min(level, most / weight) FROM filling WHERE weight * level <= most)) AS target
  FROM filling
), budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS rounds,
         target - CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END * source_size AS rest
  FROM plan
), sums AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.rounds, b.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.hash) AS own
  FROM sized d JOIN budget b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (rounds + CASE WHEN upto - own < rest AND (upto < rest OR upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sums
"""

_MARKS = r"[.!?|,;:&%#$*] "


def _tree(rows: str, text: str, name: str) -> str:
    """Columns name_root, name_paragraphs, name_sections and name_leaves of a text, by the rules of fingerprints."""
    n, digits = fingerprints.LEAF_CHARS, fingerprints.DIGITS
    ends = " OR ".join(f"d[{digits}] = '{c}'" for c in fingerprints.SECTION_END)
    return rf"""
{name}_1 AS (
  SELECT *, [p || chr(10) FOR p IN string_split({text}, chr(10))[:-2]] || string_split({text}, chr(10))[-1:] AS {name}_p FROM {rows}
), {name}_2 AS (
  SELECT *, [list_concat(e, CASE WHEN len(e) = 0 OR len(e[-1]) = {n} OR regexp_matches(e[-1], '(?s){_MARKS}$') THEN [''] ELSE [] END)
    FOR e IN [regexp_extract_all(p, '(?s).{{0,{n - 2}}}?{_MARKS}|.{{{n - 1}}}{_MARKS}|.{{{n}}}|.+') FOR p IN {name}_p]] AS {name}_q FROM {name}_1
), {name}_2b AS (
  SELECT *, [flatten([CASE WHEN len(x) = {n + 1} THEN [x[1:{n}], ' '] ELSE [x] END FOR x IN e]) FOR e IN {name}_q] AS {name}_pieces FROM {name}_2
), {name}_3 AS (
  SELECT * EXCLUDE ({name}_pieces, {name}_q), [[sha256('L' || s)[1:{digits}] FOR s IN e] FOR e IN {name}_pieces] AS {name}_d FROM {name}_2b
), {name}_4 AS (
  SELECT *, [sha256('P' || array_to_string(e, ''))[1:{digits}] FOR e IN {name}_d] AS {name}_paragraphs, list_distinct(flatten({name}_d)) AS {name}_leaves FROM {name}_3
), {name}_5 AS (
  SELECT *, [sha256('S' || s)[1:{digits}] FOR s IN string_split(array_to_string([CASE WHEN {ends} THEN d || '/' ELSE d END FOR d IN {name}_paragraphs], ''), '/')]
    AS {name}_sections FROM {name}_4
), {name} AS (SELECT * EXCLUDE ({name}_d, {name}_p), sha256('R' || array_to_string({name}_sections, '')) AS {name}_root FROM {name}_5)"""


FINGERPRINTS = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, len(coalesce(text, '')) AS n_chars FROM documents
), {_tree("docs", "t", "own")}, placed AS (
  SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER a) AS next_t, coalesce(lead(own_leaves) OVER w, first_value(own_leaves) OVER a) AS next_leaves
  FROM own WINDOW w AS (ORDER BY doc_id), a AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), edited AS (SELECT *, substr(t, 1, n_chars - n_chars // 4) || substr(next_t, 1, n_chars // 4) AS e FROM placed
), {_tree("edited", "e", "new")}
SELECT doc_id, n_chars, sha256(e) AS edited_sha256, own_root AS fingerprint, new_root AS edited_fingerprint,
  2 * len(list_intersect(own_leaves, new_leaves)) / (len(own_leaves) + len(new_leaves)) AS near_edited,
  2 * len(list_intersect(own_leaves, next_leaves)) / (len(own_leaves) + len(next_leaves)) AS near_next,
  CAST(len(own_sections) AS INTEGER) AS n_sections, CAST(len(own_paragraphs) AS INTEGER) AS n_paragraphs,
  CAST(coalesce(list_min([CASE WHEN list_contains(own_paragraphs, new_paragraphs[i]) THEN NULL ELSE i - 1 END FOR i IN range(1, len(new_paragraphs) + 1)]), -1) AS INTEGER) AS first_edited
FROM new
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TERMS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '[.]([^0-9])', ' \\1', 'g'), '[.]$', ' '), '[^a-z0-9.]+'), lambda w: w <> '')"
_TEMPLATES = ", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(licenses.TEMPLATES))
_CUE = _quoted(licenses.CUE)

LICENSES = rf"""
WITH files AS (
  SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') AS path FROM documents
), folders AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files
), found AS (
  SELECT path, hash(t) AS h, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words, unnest(list_filter(
    string_split(regexp_replace(t, '([.!?;]) +', '\1' || chr(10), 'g'), chr(10)), lambda s: regexp_matches(s, {_CUE}))) AS notice
  FROM files WHERE regexp_matches(t, {_CUE})
), notices AS (SELECT notice, count(*) AS times FROM found GROUP BY notice
), total AS (SELECT coalesce(sum(times), 0) AS n FROM notices
), df AS (SELECT term, sum(times) AS df FROM (SELECT times, unnest(list_distinct({_TERMS.format('notice')})) AS term FROM notices) GROUP BY term
), templates(template, license, notice) AS (VALUES {_TEMPLATES}
), raw AS (
  SELECT -1 AS template, notice, unnest({_TERMS.format('notice')}) AS term FROM notices
  UNION ALL SELECT template, notice, unnest({_TERMS.format('notice')}) FROM templates
), tf AS (SELECT template, notice, term, count(*) AS tf FROM raw GROUP BY ALL
), weighed AS (SELECT template, notice, term, tf * (ln((1e0 + (SELECT n FROM total)) / (1 + coalesce(df, 0))) + 1) AS w FROM tf LEFT JOIN df USING (term)
), scaled AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY template, notice)) AS v FROM weighed
), near AS (
  SELECT a.notice, t.license, round(sum(a.v * b.v), 9) AS cosine FROM scaled a JOIN scaled b ON a.term = b.term AND a.template = -1 AND b.template >= 0
  JOIN templates t ON t.template = b.template GROUP BY a.notice, b.template, t.license HAVING round(sum(a.v * b.v), 9) >= {licenses.LEAST_COSINE}
), matched AS (SELECT notice, license, cosine FROM near QUALIFY row_number() OVER (PARTITION BY notice ORDER BY cosine DESC, license) = 1
), hits AS (SELECT *, len(regexp_extract_all(notice, '[^\x20\x09-\x0D]+')) AS own_words FROM found JOIN matched USING (notice)
), texts AS (SELECT path, h, sum(own_words) >= {licenses.FILE_SHARE} * max(words) AS mostly FROM hits GROUP BY path, h
), own AS (
  SELECT path, license AS own_license, cosine, (SELECT bool_or(mostly) FROM texts x WHERE x.path = hits.path) OR regexp_matches(path, {_quoted(licenses.NAMED)}) AS license_file
  FROM hits QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, license) = 1
), speaking AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS above, own_license FROM own WHERE license_file
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY cosine DESC, path) = 1
), nearest AS (
  SELECT f.folder, s.above, s.own_license AS license FROM (SELECT DISTINCT folder FROM folders) f
  JOIN speaking s ON s.above = f.folder OR s.above = '' OR starts_with(f.folder, s.above || '/')
  QUALIFY row_number() OVER (PARTITION BY f.folder ORDER BY len(s.above) DESC) = 1
)
SELECT doc_id, path, own_license, cosine, coalesce(license_file, false) AS license_file, coalesce(own_license, n.license) AS license,
  CASE WHEN own_license IS NULL THEN n.above END AS inherited_from
FROM folders LEFT JOIN own USING (path) LEFT JOIN nearest n USING (folder)
"""

_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = rf"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_SMALL}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), tests AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_SMALL}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS win
  FROM (SELECT *, least(10, len(w)) AS m FROM tests WHERE len(w) > 0)
), places AS (
  SELECT row, m, unnest(range(1, len(w) - m + 2)) AS i, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS win
  FROM worded, (SELECT DISTINCT m FROM windows)
), met AS (SELECT DISTINCT row, i, m, item_id FROM places JOIN windows USING (m, win)
), hit AS (SELECT row, count(DISTINCT word) AS n FROM (SELECT row, unnest(range(i, i + m)) AS word FROM met) GROUP BY row
), items AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM worded LEFT JOIN hit USING (row) LEFT JOIN items USING (row)
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_SMALL}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) sizes(size)
), f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST((2000000 * CAST(c.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, phrase AS longer, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 80 * b.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
