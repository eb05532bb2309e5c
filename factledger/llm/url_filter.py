r"""URL filters with a path-template tree.

Given rules come first: a rule fits its host and every subdomain where the path starts with the rule's, and the longest
fitting rule decides (of equals, the first). Other pages are judged by their host's template tree. Digit runs and long hexadecimal segments
become placeholders at once. Then the tree is walked level by level: under each node a segment stays
literal only if it has enough pages and its share of good labelled pages differs from its siblings' (a two-proportion z
test); all other branches are merged into the wildcard ``*``. A template's purity is the share of good pages among its labelled
ones, smoothed by ``prior`` pages of its host's share, which is smoothed likewise by the overall share: hosts with few labels are
judged like all hosts. A template is rejected where its purity is under ``least_purity`` times the overall share.

All counting is done on aggregated paths, never on one host's pages in a single task. The walk goes on level by level while a
node has ``least_pages`` pages; under smaller ones no branch can differ, so their whole rest is merged in one step. Paths of
any length are walked to their end.

Defined results: null urls and those without ``://`` have an empty host and path; null labels don't count; a page with
several labels is good if all are; repeated rows are judged one by one; rules of equal length go by their order; a very long url
is a path of many segments; only the named columns are read, so others can't clash; empty tables give an empty result or one judged
by rules alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontamination import LOWER, UPPER


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none), and what it says; ``rules`` are (verdict, host/path)."""
    found = says = F.lit(None).cast("string")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found, says = F.when(fits, rule).otherwise(found), F.when(fits, verdict).otherwise(says)
    return found, says


def shape(path: Column) -> Column:
    """Segments with placeholders for numbers and long hexadecimal strings."""
    return F.transform(
        F.slice(F.split(path, "/"), 2, 1_000_000_000),
        lambda s: F.when(s.rlike("^[0-9A-Fa-f-]{16,}$"), "{hex}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")),
    )


def templates(paths: DataFrame, least_pages: int, z: float) -> DataFrame:
    """``paths`` (host, segments, n, labelled, good; one row each) with ``template``."""
    columns = ["host", "segments", "n", "labelled", "good", "template"]
    active, done, level = cut(paths.withColumn("template", F.lit("")), "url-tree"), [], 0
    while not active.isEmpty():
        here = active.withColumn("_segment", F.get("segments", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "good")]
        child = here.where("_segment IS NOT NULL").groupBy("host", "template", "_segment").agg(*sums)
        node = child.groupBy("host", "template").agg(F.count("*").alias("_children"), *(F.sum(c).alias(f"_{c}") for c in ("n", "labelled", "good")))
        others, good = F.col("_labelled") - F.col("labelled"), F.col("_good") - F.col("good")
        pooled = F.try_divide("_good", "_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "labelled") + F.try_divide(F.lit(1), others)))
        distance = F.abs(F.try_divide("good", "labelled") - F.try_divide(good, others))
        differs = F.coalesce((error > 0) & (distance > z * error), F.lit(False))  # null without labels on both sides
        literal = (F.col("_children") == 1) | ((F.col("n") >= least_pages) & differs)
        choice = child.join(node, ["host", "template"]).select(
            "host", "template", "_segment", F.when(literal, F.col("_segment")).otherwise("*").alias("_branch"), (F.col("_n") < least_pages).alias("_small")
        )
        chosen = cut(here.join(choice, ["host", "template", "_segment"], "left"), "url-level")
        rest = F.slice("segments", level + 1, 1_000_000_000)
        lists = F.collect_list(rest).over(Window.partitionBy("host", "template"))  # fewer than least_pages
        small = chosen.where("_small").withColumn("_lists", lists)
        common = F.transform(
            F.sequence(F.lit(0), F.array_max(F.transform("_lists", F.size)) - 1),
            lambda i: F.array_distinct(F.filter(F.transform("_lists", lambda s: F.get(s, i)), lambda x: x.isNotNull())),
        )
        merged = F.transform(F.slice(common, F.lit(1), F.size(rest)), lambda v: F.when(F.size(v) == 1, v[0]).otherwise("*"))
        done += [
            chosen.where("_segment IS NULL").select(*columns),
            small.withColumn("template", F.concat("template", F.lit("/"), F.array_join(merged, "/"))).select(*columns),
        ]
        longer = F.concat("template", F.lit("/"), "_branch")
        active, level = cut(chosen.where("NOT _small").withColumn("template", longer).select(*columns), "url-tree"), level + 1
    tree = active
    for part in done:
        tree = tree.unionByName(part)
    return cut(tree, "url-templates")


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], least_purity: float = 0.6, prior: float = 5.0, least_pages: int = 20, z: float = 2.58
) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity from ``pages`` (page_id, url, label_id) and ``labels`` (label_id, good)."""
    host, path = parts(F.coalesce("url", F.lit("")))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    split = pages.select("page_id", "label_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "_says": says})
    split = split.withColumn("segments", shape(F.col("path")))
    known = labels.where("label_id IS NOT NULL AND good IS NOT NULL").groupBy("label_id").agg(F.min(F.col("good").cast("int")).alias("_good"))
    judged = split.where("label_id IS NOT NULL").join(known, "label_id").groupBy("host", "segments").agg(F.count("*").alias("labelled"), F.sum("_good").alias("good"))
    none = F.lit(0).cast("long")
    counts = split.groupBy("host", "segments").agg(F.count("*").alias("n")).join(judged, ["host", "segments"], "left")
    tree = templates(counts.withColumns({"labelled": F.coalesce("labelled", none), "good": F.coalesce("good", none)}), least_pages, z)
    overall = tree.agg(F.try_divide(F.sum("good"), F.sum("labelled")).alias("p")).first()["p"]
    share = 1.0 if overall is None else float(overall)
    smoothed = lambda toward: (F.sum("good") + prior * toward) / (F.sum("labelled") + prior)
    hosts = tree.groupBy("host").agg(smoothed(share).alias("_host"))
    purity = tree.groupBy("host", "template").agg(F.sum("good").alias("_g"), F.sum("labelled").alias("_l")).join(hosts, "host")
    purity = purity.select("host", "template", ((F.col("_g") + prior * F.col("_host")) / (F.col("_l") + prior)).alias("purity"))
    verdicts = tree.join(purity, ["host", "template"]).select("host", "segments", "template", "purity")
    found = split.join(verdicts, ["host", "segments"], "left")
    verdict = F.coalesce("_says", F.when(F.col("purity") < least_purity * share, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
