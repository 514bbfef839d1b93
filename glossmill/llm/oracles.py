"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from glossmill.llm import quality_rules as Q

_WS = r"[\x20\x09-\x0D]+"
_HAS = r"[^\x20\x09-\x0D]"
_SPACES = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_CLOSERS = Q.CLOSERS.replace("'", "''")
_PHRASES = Q.BOILERPLATE.replace("'", "''")
_ENDS = ", ".join(f"'{x}'" for x in Q.LINE_ENDS)


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}'), lambda w: w <> '')"


QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, {_words("t")} AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
tri AS (SELECT rid, i, n, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM tri WHERE i <= n - 2 QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cov AS (SELECT rid, count(DISTINCT j) AS k FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM d),
v AS (SELECT *, trim(line, {_SPACES}) AS s FROM l),
r AS (SELECT *, len(regexp_split_to_array(s, '{_WS}')) AS n, len(regexp_split_to_array(s, '{Q.ENTRIES}')) AS e, len(regexp_split_to_array(s, '{Q.MARKS}')) - 1 AS m FROM v),
f AS (SELECT rid, j, line, s = '' AS blank,
  right(rtrim(s, '{_CLOSERS}'), 1) IN ({_ENDS}) AND NOT (e >= 3 AND n <= 5 * e) AND m <= {Q.MAX_MARKS} * n
  AND NOT (n <= {Q.PHRASE_WORDS} AND regexp_matches(s, '{_PHRASES}')) AS good FROM r),
g AS (SELECT rid, string_agg(line, chr(10) ORDER BY j) FILTER (WHERE blank OR good) AS cleaned,
  count(*) FILTER (WHERE NOT blank) - count(DISTINCT line) FILTER (WHERE NOT blank) AS dups FROM f GROUP BY rid),
x AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_WS}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '{Q.SYMBOLS}', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
  coalesce(k, 0) AS n_repeat_words, coalesce(cleaned, '') AS cleaned
  FROM d JOIN w USING (rid) LEFT JOIN g USING (rid) LEFT JOIN cov USING (rid)),
y AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEAT} * n_words AS base_failed FROM x)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND length(regexp_replace(cleaned, '{_WS}', '', 'g')) >= {Q.MIN_LEFT} * word_chars AS kept,
  md5(cleaned) AS cleaned_md5, length(cleaned)::BIGINT AS cleaned_chars
FROM y
"""

NEAREST = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL),
f AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: Equal bytes can't be had from SQL in one pass; the size, checksum and law can, and so can
#: the numbering laws, which the tests check by brute force.
ORACLES: dict[str, str] = {"op8_neighbours": NEAREST, "op9_quality_rules": QUALITY}
