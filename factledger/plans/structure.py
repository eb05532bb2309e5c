"""Long texts split, and pages read to section-aware blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators import structure as S
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


def sql_split(source: str, key: str, most: int) -> str:
    """Recursive CTE ``cut`` (key columns, s, piece) over ``source`` (key columns, text): texts of up to ``most`` characters as they are, longer ones split."""
    return rf"""
cut_ AS (
  SELECT {key}, 0 AS s, length(text) > {most} AS long, text AS rest, NULL::VARCHAR AS piece FROM {source}
  UNION ALL
  SELECT {key}, s + 1, long, CASE WHEN place > 0 THEN ltrim(substr(rest, place), chr(10)) END, CASE WHEN NOT long THEN rest WHEN place > 0 THEN regexp_replace(substr(rest, 1, place - 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace(rest, '^\s+|\s+$', '', 'g') END
  FROM (
    SELECT *, CASE WHEN length(rest) <= {most} THEN 0 WHEN contains(substr(rest, 1, {most}), chr(10)) THEN length(regexp_extract(substr(rest, 1, {most}), '(?s)^(.*)\n', 1)) + 1
      WHEN contains(substr(rest, {most} + 1), chr(10)) THEN {most} + strpos(substr(rest, {most} + 1), chr(10)) ELSE 0 END AS place FROM cut_ WHERE rest IS NOT NULL)
), cut AS (SELECT {key}, s, piece FROM cut_ WHERE s > 0 AND (piece <> '' OR NOT long))"""


@query(f"""
WITH RECURSIVE {sql_split("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", "doc_id", 600)}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s)::INT AS seq, length(piece)::INT AS chars, md5(piece) AS piece_md5 FROM cut
""")
def split_at_line_ends(t) -> DataFrame:
    """Documents in pieces of up to 600 characters that end at line ends; longer lines stay whole."""
    rows = t("documents").where("text IS NOT NULL").select("doc_id", F.posexplode(S.line_pieces(600)("text")).alias("k", "piece"))
    return rows.select("doc_id", (F.col("k") + 1).alias("seq"), F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


SQL_PAGES = r"""
  SELECT coalesce(source, '') || '/' || coalesce(lang, '') AS record, doc_id AS page,
    replace(replace(replace(regexp_replace(regexp_replace(text, '(^|\n)([AEIOU])', '\1# \2', 'g'), '(^|\n)([DLT])', '\1### \2', 'g'), ', ', ' | '), ' and ', ' --- '), ' des ', ' --- ') AS text FROM documents WHERE text IS NOT NULL
"""


def marked_pages(t) -> DataFrame:
    """The documents of a source and language as the pages of a record: some lines are headers of two levels, and commas and two words make tables."""
    text = F.regexp_replace(F.regexp_replace("text", r"(^|\n)([AEIOU])", "$1# $2"), r"(^|\n)([DLT])", "$1### $2")
    for old, new in ((", ", " | "), (" and ", " --- "), (" des ", " --- ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    record = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    return t("documents").where("text IS NOT NULL").select(record.alias("record"), F.col("doc_id").alias("page"), text.alias("text"))


@query(rf"""
WITH RECURSIVE p AS ({SQL_PAGES}), l AS (
  SELECT record, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p
), h AS (
  SELECT *, regexp_matches(line, '^#+\s+') AS head, count(*) FILTER (regexp_matches(line, '^#+\s+')) OVER (PARTITION BY record ORDER BY page, pos) AS g FROM l
), k AS (
  SELECT *, last_value(CASE WHEN contains(line, '|') THEN 'TABLE' WHEN regexp_matches(line, '\S') THEN 'TEXT' END IGNORE NULLS) OVER (PARTITION BY record, page, g ORDER BY pos) AS kind FROM h WHERE NOT head
), n AS (
  SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY record, page, g ORDER BY pos), false)::INT AS new FROM k
), c AS (
  SELECT *, sum(new) OVER (PARTITION BY record, page, g ORDER BY pos) AS c FROM n
), b AS (
  SELECT record, page, g, c, bool_or(contains(line, '|') AND contains(line, '---')) AS is_table, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM c GROUP BY ALL HAVING regexp_matches(string_agg(line, ' '), '\S')
), {sql_split("(SELECT record, page, g, c, text FROM b WHERE NOT is_table)", "record, page, g, c", 3000)}, r AS (
  SELECT record, page, g, c, s, 'TEXT' AS kind, piece FROM cut UNION ALL SELECT record, page, g, c, 1, 'TABLE', text FROM b WHERE is_table
), v AS (
  SELECT *, lag(right(piece, 300)) OVER (PARTITION BY record ORDER BY page, g, c, s) AS before, row_number() OVER (PARTITION BY record, page ORDER BY g, c, s) - 1 AS seq FROM r
), t AS (
  SELECT record, row_number() OVER (PARTITION BY record ORDER BY page, pos) AS k, length(regexp_extract(line, '^#+')) AS level, regexp_replace(regexp_replace(line, '^#+\s+', ''), '\s+$', '') AS title FROM h WHERE head
), q AS (
  SELECT record, 0 AS k, []::VARCHAR[] AS stack FROM (SELECT DISTINCT record FROM p) UNION ALL SELECT t.record, t.k, list_concat(q.stack[1:t.level - 1], [t.title]) FROM q JOIN t ON t.record = q.record AND t.k = q.k + 1
)
SELECT v.record, page, seq::INT AS seq, kind, md5(array_to_string(stack, ' > ')) AS path_md5, len(stack)::INT AS depth, md5(CASE WHEN kind = 'TEXT' AND before <> '' THEN '[Previous Context: ' || before || ']' || chr(10) || chr(10) || piece ELSE piece END) AS content_md5
FROM v JOIN q ON q.record = v.record AND q.k = v.g
""")
def paged_blocks(t) -> DataFrame:
    """Blocks of paged records: headers and the last 300 characters carry over from page to page, headers and tables cut blocks, long texts are split."""
    blocks = S.blocks_of_pages(marked_pages(t), "record", "page")
    return blocks.select("record", "page", "seq", "kind", F.md5(F.array_join("path", " > ")).alias("path_md5"), F.size("path").alias("depth"), F.md5("content").alias("content_md5"))


QUERIES, ORACLES = registry.queries, registry.oracles
