"""The contract queries: each derives its digest columns from what its operator returns or writes."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, merkle, mixing, near_dedup, pii, quality, sharding, spelling, suffix_dedup, tokens, url_filter, warc
from .common import cut, table


def op1_decontaminate_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.match(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.col("_match.item_ids")
    return found.select(
        "doc_id",
        "_match.n_words",
        "_match.n_hit",
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        "_match.contaminated",
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), v AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v))
), h AS (
  SELECT doc_id, size, i, item FROM g JOIN v USING (size, gram)
), n AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM h) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op2_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path; good: quality 1 and not toxic."""
    number = F.regexp_extract(url_filter.parts(F.coalesce("url", F.lit("")))[1], "([0-9]{1,18})[^0-9/]*/?$", 1)
    pages = table(spark, sf_dir, "pages", "page_id", "url").withColumn("label_id", F.when(number != "", number).cast("long"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").select(
        F.col("doc_id").alias("label_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")
    )
    return url_filter.judge(pages, labels, RULES)


def op3_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(odd)
    read = chat.masked(chat.expand(turns))
    written = F.when(
        F.col("last"),
        F.array_join(F.transform(chat.parse(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
    )
    n_turns = F.when(F.col("last"), F.size(chat.parse(F.col("text"))))
    rows = read.select("conv_id", "example", "loss_text", F.length("text").cast("long").alias("chars"), n_turns.alias("n"), written.alias("all"))
    in_order = F.array_sort(F.collect_list(F.struct("example", "loss_text")))
    loss = F.array_join(F.col("losses.loss_text"), "")
    return (
        rows.groupBy("conv_id")
        .agg(F.max("n").cast("long").alias("n_turns"), F.sha2(F.max("all"), 256).alias("turns_sha256"), in_order.alias("losses"), F.sum("chars").alias("formatted_chars"))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.length(loss).cast("long").alias("loss_chars"),
            F.sha2(loss, 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e AS (
  SELECT *, 9 + length(replace(replace(replace(replace(role || text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')) + 1 AS piece,
    row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS turns
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), c AS (
  SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY n) AS so_far FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(so_far) FILTER (role = 'assistant' OR n = turns), 0)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(tokens.write(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), end_id=2))


def op5_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), weights=(3, 1, 2), budget=1.5, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS turn, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w) OVER (ORDER BY cap / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w
), f AS (
  SELECT *, cap <= level * w AS is_full FROM l
), g AS (
  SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE w * (SELECT arg_min(level, (cap / w, turn)) FROM f WHERE NOT is_full) END AS target FROM f
), r AS (
  SELECT doc_id, size, source_size, target,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS rank,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('5:' || coalesce('s' || d.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, ((floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM r
"""


def op6_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text"))
    named = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(F.array_join(named(F.col("base")), ","), 256).alias("base_sha256"),
        F.array_join(named(F.concat("base", "terms")), ",").alias("spans"),
        F.col("sanitised_chars").cast("long").alias("sanitised_chars"),
        "sanitised_sha256",
    )


def op7_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents", "doc_id", "text"), size=2, percent=80)


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), t AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
), m AS (
  SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


OP8_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d)
), r AS (
  SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1
), i AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true)::INT AS new FROM r
), k AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i
), s AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM k GROUP BY doc_id, k
), g AS (
  SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s
), m AS (
  SELECT g.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(z) AS last
  FROM g JOIN d USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
"""


def op9_shard_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    placed = sharding.shard_rows(rows, F.col("key"), F.col("size"), shards=40)  # equal texts stay together
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), sample_rows=20_000)
    return quality.judge(docs, trees).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "bad")


def misspelt(doc: str, run: str) -> str:
    """Where 31 divides the crc32 of ``<doc>:<run>``, the run without one letter."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_runs(table(spark, sf_dir, "documents", "doc_id", "text"), "[A-Za-z\u00C0-\u00FF]+", shortest=7, change=misspelt)
    return spelling.group(words.where("n >= 2"), ratio=10)


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), o AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), g AS (
  SELECT run, hex(encode(doc || ':' || run)) AS x, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY doc, run
), h AS (
  SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM g, crc
), w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
), v AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word
  UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word
), b AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS best, max(near_n) AS best_n FROM p GROUP BY word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)
), r AS (
  SELECT word, word AS at, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up
)
SELECT f.*, r.at AS root FROM f JOIN r ON r.word = f.word AND r.up IS NULL
"""

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered leaf is there only where the record was tampered with."""
    docs = table(spark, sf_dir, "documents", *FIELDS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = merkle.leaf(*(F.translate(c, upper, lower) if c == "text" else F.col(c) for c in FIELDS))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select("doc_id", "lang", merkle.leaf(*map(F.col, FIELDS)).alias("digest"), F.when(chosen, tampered).alias("tampered"))
    proved = merkle.manifest(leaves, "lang", ["doc_id"], "digest", keep=["doc_id", "tampered"])
    folded = merkle.fold(F.coalesce("tampered", "leaf"))
    return proved.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    xor(list_reduce(list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM documents, crc
), l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN h % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS tampered FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l
), t AS (
  SELECT 0 AS level, tree, i, n, leaf AS digest FROM r
  UNION ALL
  SELECT level + 1, tree, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, tree, i // 8, n
), s AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 8, n
), b AS (
  SELECT top, tree, level, i, digest FROM (SELECT 0 AS top, tree, level, i, n, digest FROM t UNION ALL SELECT 1, '', level, i, n, digest FROM u) WHERE n > 1
), c AS (
  SELECT top, tree, level, i, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM b WINDOW w AS (PARTITION BY top, tree, level, i // 8 ORDER BY i)
), f AS (
  SELECT tree, i AS row, 0 AS level, i, coalesce(tampered, leaf) AS digest, '' AS proof FROM r
  UNION ALL
  SELECT f.tree, row, f.level + 1, f.i // 8, sha256(before || digest || behind), proof || before || behind FROM f JOIN c ON c.top = 0 AND c.tree = f.tree AND c.level = f.level AND c.i = f.i
), g AS (
  SELECT tree, row, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM f GROUP BY tree, row
), k AS (
  SELECT g.tree, row, 0 AS level, s.i, digest, proof FROM g JOIN s USING (tree)
  UNION ALL
  SELECT k.tree, row, k.level + 1, k.i // 8, sha256(before || digest || behind), proof || before || behind FROM k JOIN c ON c.top = 1 AND c.level = k.level AND c.i = k.i
), e AS (
  SELECT tree, row, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM k GROUP BY tree, row
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = (SELECT digest FROM u WHERE n = 1) AS verified
FROM r JOIN s USING (tree) JOIN e ON e.tree = r.tree AND e.row = r.i
"""


def op13_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are measured on what is read back; revisits are read by their headers alone."""
    path = warc.write(warc.records(table(spark, sf_dir, "pages", "page_id", "url", "html"), least=0))
    page = F.regexp_extract("refers_to", "^urn:page:(-?[0-9]+):", 1)
    whole = warc.read(spark, path).where("record_type = 'response'").withColumn("bytes", F.octet_length("payload").cast("long"))
    heads = warc.read(spark, path, payload="false").where("record_type = 'revisit'").withColumn("bytes", F.col("http_length"))
    refers = F.when(page != "", page).cast("long").alias("refers_to")
    return whole.unionByName(heads).select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", refers)


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(sha1(html), {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT), 1)" for k in range(4) for j in range(8))
OP13_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), r AS (
  SELECT page_id, html, row_number() OVER w AS turn, first_value(page_id) OVER w AS last FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN turn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN turn > 1 THEN last END AS refers_to FROM r
"""


QUERIES = {
    "op1_decontaminate_automaton": op1_decontaminate_automaton,
    "op2_url_template_tree": op2_url_template_tree,
    "op3_chat_prefix_targets": op3_chat_prefix_targets,
    "op4_token_wavelet_shards": op4_token_wavelet_shards,
    "op5_mix_systematic": op5_mix_systematic,
    "op6_pii_disclosure": op6_pii_disclosure,
    "op7_minhash_odd_sketch": op7_minhash_odd_sketch,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_shard_bounded_ring": op9_shard_bounded_ring,
    "op10_quality_boosted_trees": op10_quality_boosted_trees,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_warc_source": op13_warc_source,
}
ORACLES = {"op1_decontaminate_automaton": OP1_SQL, "op3_chat_prefix_targets": OP3_SQL, "op5_mix_systematic": OP5_SQL, "op7_minhash_odd_sketch": OP7_SQL, "op8_suffix_array_dedup": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_warc_source": OP13_SQL}
