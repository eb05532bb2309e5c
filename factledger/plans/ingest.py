"""Text, blocks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.functions import numeric, text
from factledger.operators import ingest as I
from factledger.plans.common import Registry

registry = Registry()
query = registry.query


@query(r"""
WITH s AS (SELECT conv_id, unnest(string_split_regex(text, '[.!?]\s')) AS s FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, count(*) AS sentences, round(avg((length(s) > 40)::INT), 6) AS groundedness FROM s WHERE trim(s) <> '' GROUP BY conv_id
""")
def sentence_groundedness(t) -> DataFrame:
    """Share of a conversation's sentences that a rule grounds (here: long enough to hold a fact)."""
    rows = t("conversations").select("conv_id", F.explode(F.split("text", r"[.!?]\s")).alias("s")).where(F.trim("s") != "")
    return rows.groupBy("conv_id").agg(F.count("*").alias("sentences"), F.round(F.avg((F.length("s") > 40).cast("int")), 6).alias("groundedness"))


@query(r"SELECT doc_id, md5(source || '::' || regexp_replace(trim(lower(text)), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS chunk_id FROM documents")
def chunk_ids(t) -> DataFrame:
    return t("documents").select("doc_id", text.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"))


@query("""
WITH p AS (SELECT conv_id, turn, text, lag(right(text, 300)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN b IS NULL THEN text ELSE '[Previous Context: ' || b || ']' || chr(10) || chr(10) || text END) AS content_md5 FROM p
""")
def previous_context(t) -> DataFrame:
    """Each turn after the last 300 characters of the one before."""
    return I.with_previous(t("conversations"), "conv_id", "turn").select("conv_id", "turn", F.md5("content").alias("content_md5"))


@query("""
WITH l AS (
  SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents
), k AS (
  SELECT *, coalesce(last_value(CASE WHEN contains(line, '|') THEN 'TABLE' WHEN trim(line) <> '' THEN 'TEXT' END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq), 'TEXT') AS kind FROM l
), n AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY id ORDER BY seq))::INT AS new FROM k),
b AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS block FROM n)
SELECT id, block, kind, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY seq)) AS content_md5 FROM b GROUP BY id, block, kind
""")
def segment_blocks(t) -> DataFrame:
    """Documents cut into table and text blocks."""
    rows = I.lines(t("documents").select(F.col("doc_id").alias("id"), "text"))
    return I.segment(rows).select("id", "block", "kind", "n_lines", F.md5("content").alias("content_md5"))


@query("""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS seq FROM documents),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, length(line) % 4 + 1 AS level, string_split(line, ' ')[1] AS title FROM l WHERE trim(line) <> ''),
r AS (SELECT doc_id, k, [title] AS stack FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.k, list_concat(r.stack[1:h.level - 1], [h.title]) FROM r JOIN h ON h.doc_id = r.doc_id AND h.k = r.k + 1)
SELECT doc_id, count(*)::INT AS headers, md5(string_agg(array_to_string(stack, ' > '), chr(10) ORDER BY k)) AS paths_md5, arg_max(array_to_string(stack, ' > '), k) AS last_path FROM r GROUP BY doc_id
""")
def header_paths(t) -> DataFrame:
    """Section paths: a line's length stands for its level, its first word for the title."""
    rows = I.lines(t("documents").select(F.col("doc_id").alias("id"), "text")).where(F.trim("line") != "")
    header = F.struct("seq", (F.length("line") % 4 + 1).alias("level"), F.substring_index("line", " ", 1).alias("title"))
    headers = rows.groupBy("id").agg(F.array_sort(F.collect_list(header)).alias("h"))
    paths = I.header_path(F.transform("h", lambda h: F.struct(h["level"].alias("level"), h["title"].alias("title"))))
    return headers.select(F.col("id").alias("doc_id"), F.size("h").alias("headers"), F.md5(F.array_join(paths, "\n")).alias("paths_md5"), F.element_at(paths, -1).alias("last_path"))


@query(r"""
SELECT doc_id, NOT regexp_matches(text, '(?i)\$[\d,]|\brevenue\b|\bsales\b|net income|gross profit|\bloss\b|\bcash\b|goodwill') AND (length(trim(text)) < 10 OR length(regexp_replace(text, '[^☒☐✓✗]', '', 'g')) >= 2
  OR regexp_matches(trim(text), '(?i)^(https?://\S+\s*)+$')) AS boilerplate FROM documents
""")
def boilerplate_filter(t) -> DataFrame:
    """Blocks without a fact."""
    return t("documents").select("doc_id", I.is_boilerplate(F.col("text"), F.lit("")).alias("boilerplate"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k FROM events WHERE value > 5 OR event_type = 'purchase' OR (json_extract_string(props, '$.k'))::INT >= 90")
def useful_rows(t) -> DataFrame:
    """Rows with a value, a type or a property that can be used."""
    rows = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.where((F.col("value") > 5) | (F.col("event_type") == "purchase") | (F.col("k") >= 90)).select("event_id", "k")


@query("SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def exact_align(t) -> DataFrame:
    """Where items stand word for word in documents."""
    return I.align(t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text"))


@query(r"""
WITH b AS (SELECT item_id, text, trim(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ') AS q FROM benchmark),
d AS (SELECT doc_id, text, regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g') AS c FROM documents)
SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN strpos(d.text, b.text) ELSE strpos(c, q) END - 1 AS position FROM b JOIN d ON contains(c, q)
""")
def exact_align_collapsed(t) -> DataFrame:
    """Where items stand in documents, word for word or else with white space collapsed."""
    return I.align(t("benchmark").select("item_id", "text"), t("documents").select("doc_id", "text"), collapsed=True)


@query("SELECT doc_id, md5(text) AS content FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_pass_dedup(t) -> DataFrame:
    """The first of each content key."""
    return t("documents").groupBy(F.md5("text").alias("content")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content")


@query("""
WITH c AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN '—' WHEN 1 THEN '(' || l_quantity::INT::VARCHAR || ')' WHEN 2 THEN '$ ' || l_quantity::INT::VARCHAR || ',000(2)'
    WHEN 3 THEN 'n/a' ELSE l_quantity::INT::VARCHAR || 'b' END AS cell, l_quantity::INT AS q FROM lineitem
)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 5 WHEN 0 THEN 0 WHEN 1 THEN -q WHEN 2 THEN q * 1000 WHEN 3 THEN NULL ELSE q END::DOUBLE AS value,
  CASE l_linenumber % 5 WHEN 0 THEN 'Dash treated as zero' WHEN 1 THEN 'Negative (parentheses)' END AS nuance FROM c
""")
def cell_parse(t) -> DataFrame:
    """Dashes, parentheses, footnotes, money signs, trailing letters and placeholders in cells."""
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 5
    cell = (
        F.when(kind == 0, "—").when(kind == 1, F.concat(F.lit("("), q, F.lit(")"))).when(kind == 2, F.concat(F.lit("$ "), q, F.lit(",000(2)")))
        .when(kind == 3, "n/a").otherwise(F.concat(q, F.lit("b")))
    )
    rows = t("lineitem").withColumn("p", numeric.parse_cell(cell))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.value", "p.nuance")


@query(r"""
WITH l AS (
  SELECT doc_id AS id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row, unnest(string_split(text, chr(10))) AS line FROM documents
), c AS (
  SELECT id, row, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS cells FROM l WHERE contains(line, '|') AND NOT contains(line, '---')
), x AS (SELECT id, row, unnest(cells) AS cell FROM c)
SELECT id, count(DISTINCT row) AS n_rows, count(*) AS n_cells, count(*) FILTER (trim(cell) = '') AS n_empty FROM x GROUP BY id
""")
def table_cells(t) -> DataFrame:
    """Rows and cells of the pipe tables in documents."""
    grid = I.cells(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return grid.groupBy("id").agg(F.count_distinct("row").alias("n_rows"), F.count("*").alias("n_cells"), F.count_if(F.col("cell") == "").alias("n_empty"))


@query("""
WITH r AS (
  SELECT n_name, year(o_orderdate) AS y, sum(l_quantity::DECIMAL(18,2))::BIGINT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
)
SELECT n_name AS id, 'Quantity' AS metric_name, q * 1000.0::DOUBLE AS num_value, 'USD' AS unit, 1000.0::DOUBLE AS scale, y::VARCHAR AS period_end, NULL::VARCHAR AS nuance FROM r
UNION ALL
SELECT n_name, 'Quantity per share', -q::DOUBLE, 'USD/Share', 1.0::DOUBLE, y::VARCHAR, 'Negative (parentheses)' FROM r
""")
def table_melt(t) -> DataFrame:
    """A markdown table for each nation, built from order lines and melted back into facts in thousands."""
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    sums = joined.groupBy("n_name", F.year("o_orderdate").cast("string").alias("y")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("long").cast("string").alias("q"))
    in_order = sums.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("y", "q"))).alias("cells"))
    line = lambda label, f: F.concat(F.lit(f"| {label} | "), F.array_join(F.transform("cells", f), " | "), F.lit(" |"))
    content = F.concat_ws(
        "\n", line("Item", lambda c: c["y"]), F.lit("|---|"), line("Quantity (1)", lambda c: c["q"]), line("Quantity per share", lambda c: F.concat(F.lit("("), c["q"], F.lit(")")))
    )
    grid = I.cells(in_order.select(F.col("n_name").alias("id"), content.alias("content")))
    return I.melt(grid, F.lit("(In thousands)"))


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, coalesce(n_chars, 0) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (
  SELECT source, doc_id, size, k, size <= 20000 AS taken, 20000 - CASE WHEN size <= 20000 THEN size ELSE 0 END AS room FROM d WHERE k = 1
  UNION ALL SELECT d.source, d.doc_id, d.size, d.k, d.size <= r.room, r.room - CASE WHEN d.size <= r.room THEN d.size ELSE 0 END FROM r JOIN d ON d.source = r.source AND d.k = r.k + 1
)
SELECT source, doc_id, size FROM r WHERE taken
""")
def greedy_packing(t) -> DataFrame:
    """Whole documents packed into each source's budget, skipping what doesn't fit."""
    docs = t("documents").select("source", F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    return I.pack(docs, "source", 20_000).where("taken").select("source", F.col("id").alias("doc_id"), "size")


@query("""
WITH RECURSIVE d AS (SELECT source, doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS size, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents WHERE text <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY done DESC, CASE WHEN done THEN '' ELSE md5(doc_id::VARCHAR) END, doc_id) AS k FROM d WHERE size <= 30),
r AS (
  SELECT source, doc_id, size, k, size <= 60 AS taken, 60 - CASE WHEN size <= 60 THEN size ELSE 0 END AS room FROM o WHERE k = 1
  UNION ALL SELECT o.source, o.doc_id, o.size, o.k, o.size <= r.room, r.room - CASE WHEN o.size <= r.room THEN o.size ELSE 0 END FROM r JOIN o ON o.source = r.source AND o.k = r.k + 1
)
SELECT source, doc_id, size::INT AS size FROM r WHERE taken
""")
def packing_done_first(t) -> DataFrame:
    """Documents of up to 30 lines packed into 60 lines a source, those that have a label already first."""
    known = t("labels").select("doc_id").distinct().withColumn("done", F.lit(True))
    docs = t("documents").where("text <> ''").join(known, "doc_id", "left").select("source", F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("size"), "done").where("size <= 30")
    return I.pack_done_first(docs, "source", 60).where("taken").select("source", F.col("id").alias("doc_id"), "size")


@query("SELECT n_name, y, total, lead(total) OVER (PARTITION BY y ORDER BY n_name) AS below, lag(total) OVER (PARTITION BY y ORDER BY n_name) AS above, "
       "lead(total) OVER (PARTITION BY n_name ORDER BY y) AS \"right\" FROM (SELECT n_name, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total "
       "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)")  # fmt: skip
def neighbour_cells(t) -> DataFrame:
    """The cells below, above and right of each cell of a grid of nations and years."""
    from factledger.operators.factory import neighbours

    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grid = joined.groupBy("n_name", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return neighbours(grid, "n_name", "y", "total")


@query("SELECT doc_id, text[1:1] = '' OR text IS NULL AS is_empty, (length(text) / 4)::DOUBLE AS quarter, floor(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(t) -> DataFrame:
    """Token counts estimated from lengths."""
    length = F.length("text")
    return t("documents").select("doc_id", (F.coalesce(F.col("text"), F.lit("")) == "").alias("is_empty"), (length / 4).alias("quarter"), text.word_count_estimate(F.col("text")).alias("tokens"))


QUERIES, ORACLES = registry.queries, registry.oracles
