"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from dipstick.llm import licences

_BLANK = "[^\\x20\\x09-\\x0D]+"

SOURCE_MIX = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_BLANK}')) AS size, coalesce(text, '') AS t,
         (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), keyed AS (
  SELECT doc_id, source, size,
         -ln(u) / (1 - 0.5 * least(1.0, (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(size, 1))) AS key
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM keyed GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked
), goals AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio) * weight) AS target FROM levels
), running AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, floor(g.target / greatest(g.source_size, 1)) AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""

SITE_LINES = """
WITH lines AS (
  SELECT doc_id, source, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), each AS (
  SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines
), bare AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM each
), totals AS (
  SELECT source, count(*) AS n_pages FROM documents GROUP BY source
), common AS (
  SELECT c.source, c.b FROM (SELECT source, b, count(DISTINCT r) AS n FROM bare WHERE b <> '' GROUP BY ALL) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE c.n >= 5 AND c.n > 0.05 * t.n_pages
), marked AS (
  SELECT bare.*, common.b IS NULL AS stays FROM bare LEFT JOIN common ON bare.source IS NOT DISTINCT FROM common.source AND bare.b = common.b
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '') AS text
FROM marked GROUP BY r, doc_id
"""


def licence_scan() -> str:
    """The scan written out: places where three words of a text stand as in a template, by diagonal."""
    rows = [(f"p:{label}", label, "true", text) for label, text in licences.PHRASES.items()]
    rows += [(f"t:{label}", label, "false", text) for label, text in licences.TEMPLATES.items()]
    values = ", ".join(f"('{t}', '{label}', {phrase}, '{text}')" for t, label, phrase, text in rows)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH wording(template, label, phrase, words) AS (SELECT a, b, c, string_split(d, ' ') FROM (VALUES {values}) v(a, b, c, d)),
places AS (
  SELECT template, label, phrase, len(words) - 2 AS places, pos AS place, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS gram
  FROM (SELECT *, unnest(range(len(words) - 2)) AS pos FROM wording)
), base AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), grams AS (
  SELECT r, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS gram
  FROM (SELECT *, unnest(range(greatest(len(words) - 2, 0))) AS pos FROM base)
), diagonals AS (
  SELECT r, template, label, phrase, places, pos - place AS diagonal, list(DISTINCT place) AS held,
         min(pos) AS s, max(pos) + 3 AS e
  FROM grams JOIN places USING (gram) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN phrase OR lag(diagonal) OVER w IS NULL OR abs(diagonal - lag(diagonal) OVER w) > 4
                      OR s > max(e) OVER (PARTITION BY r, template ORDER BY s, diagonal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4
                 THEN 1 ELSE 0 END AS new
  FROM diagonals WINDOW w AS (PARTITION BY r, template ORDER BY s, diagonal)
), spans AS (
  SELECT r, template, label, phrase, places, span, min(s) AS s, len(list_distinct(flatten(list(held))))::DOUBLE / max(places) AS share
  FROM (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY s, diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked)
  GROUP BY r, template, label, phrase, places, span
), summary AS (
  SELECT r, count(*) FILTER (phrase AND share = 1) AS n_base, min(s) FILTER (phrase AND share = 1) AS first_word,
         max(s) FILTER (phrase AND share = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase AND share = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((phrase AND share = 1) OR (NOT phrase AND share >= 0.7)) AS labels,
         max(share) AS score
  FROM spans GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM base LEFT JOIN summary USING (r)
"""
