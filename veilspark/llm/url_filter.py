"""URL filter: fixed host and path rules first, a path-template tree for the rest.

URLs are first reduced to distinct (host, path) pairs with counts. The tree then grows one path segment at a time: at
each node, the many rare children of a variable segment become one wildcard (``*``), and branches whose labelled share
doesn't differ from that of their siblings by the Hoeffding bound are merged (``~``). A node with few URLs is not split
further (``**``), so that growth ends with the data and not at a fixed depth. A template's purity is its bad share among
labelled URLs, smoothed by the mean of its parent's purity and the share of all labelled URLs; it is rejected from
``REJECT`` on, which labels of others alone don't reach while the share of all is moderate.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import materialize

#: (verdict, host, path): fits the host and its subdomains where the URL's path starts with the path; the longest wins.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A segment is variable where a node's URLs are spread over at least ``LEAST_FAN`` children with fewer than ``SPREAD``
#: URLs each on average, or over more than ``FANOUT``; its children with under 1/SPREAD of the URLs are rare.
LEAST_FAN, SPREAD, FANOUT = 4, 4, 32
#: Nodes with fewer URLs are not split; branches with fewer labelled URLs are not merged for their labels.
LEAST = 5
ALPHA = 0.05
#: Weight of the prior, in URLs, and the smoothed bad share from which a template is rejected.
PRIOR, REJECT = 4.0, 0.9


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct<size,rule,verdict> of the longest rule that fits, else null. Rules are a short list of literals."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string,h:string,p:string>")
    table = F.array(*[F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in rules])
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    return F.array_max(fits)


def segments(path: Column) -> Column:
    return F.split(F.regexp_replace(path, "^/", ""), "/", -1)


def _similar(lab: Column, bad: Column, all_lab: Column, all_bad: Column) -> Column:
    """Whether a branch's bad share is within the Hoeffding bound of its siblings'."""
    rest = all_lab - lab
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / F.sqrt(lab) + 1 / F.sqrt(rest))
    near = F.abs(bad / lab - (all_bad - bad) / rest) < bound
    return F.when((lab >= LEAST) & (rest >= LEAST), near).otherwise(F.lit(False))


def smoothed(bad: Column, lab: Column, parent: Column, prior: float) -> Column:
    return (bad + PRIOR * (parent + prior) / 2) / (lab + PRIOR)


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, purity) of the distinct URLs; ``urls`` has host, path and bad (1, 0, or null if unlabelled).

    Each round names the children of all open nodes; rows leave when their path or their node's URLs come to an end.
    """
    counted = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = materialize(counted)
    lab, bad = rows.agg(F.sum("lab"), F.sum("bad")).first()  # two numbers
    prior = (bad or 0) / lab if lab else 0.0
    sums = lambda p="": [F.sum(c).alias(p + c) for c in ("n", "lab", "bad")]
    state = ["host", "path", "segs", "n", "lab", "bad", "template", "purity"]
    at = rows.select("host", "path", segments(F.col("path")).alias("segs"), "n", "lab", "bad", F.lit("").alias("template"))
    hosts = materialize(rows.groupBy("host").agg(*sums()).select("host", smoothed(F.col("bad"), F.col("lab"), F.lit(prior), prior).alias("purity")))
    open_rows, finished, depth = materialize(at.join(hosts, "host").select(*state)), [], 0
    while not open_rows.isEmpty():
        here = open_rows.withColumn("segment", F.get("segs", F.lit(depth)))
        kids = materialize(here.groupBy("host", "template", "segment").agg(*sums(), F.first("purity").alias("up")))
        nodes = materialize(kids.groupBy("host", "template").agg(F.count("*").alias("fan"), *sums("all_")))
        spread = (F.col("fan") >= LEAST_FAN) & ((F.col("fan") * SPREAD > F.col("all_n")) | (F.col("fan") > FANOUT))
        variable = spread & (F.col("n") * SPREAD <= F.col("all_n"))
        name = (
            F.when(F.col("all_n") < LEAST, "**").when(variable, "*")
            .when(_similar(*map(F.col, ("lab", "bad", "all_lab", "all_bad"))), "~").otherwise(F.col("segment"))
        )
        named = materialize(kids.join(nodes, ["host", "template"]).select("host", "template", "segment", name.alias("name"), "n", "lab", "bad", "up"))
        merged = named.groupBy("host", "template", "name").agg(*sums(), F.first("up").alias("up"))
        judged = materialize(merged.select("host", "template", "name", smoothed(F.col("bad"), F.col("lab"), F.col("up"), prior).alias("own")))
        known = materialize(named.join(judged, ["host", "template", "name"]).select("host", "template", "segment", "name", "own"))
        grown = here.drop("purity").join(known, ["host", "template", "segment"])
        ends = (F.col("name") == "**") | (F.size("segs") == depth + 1)
        grown = materialize(grown.select(
            "host", "path", "segs", "n", "lab", "bad", F.concat("template", F.lit("/"), "name").alias("template"), F.col("own").alias("purity"), ends.alias("ends")
        ))
        finished.append(grown.where("ends").select("host", "path", "template", "purity"))
        open_rows, depth = grown.where("not ends").select(*state), depth + 1
    return reduce(DataFrame.unionByName, finished) if finished else open_rows.select("host", "path", "template", "purity")


def judge(pages: DataFrame, rules=RULES, labelled: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), one row for each row of ``pages``.

    The verdict is the longest fitting rule's, else the template's: block if its purity is at least ``REJECT``.
    ``labelled`` (1 bad, 0 good, null unknown) trains the tree; by default the rules' own verdicts do. Null URLs and
    those without ``://`` have empty host and path; they share one template. Repeated rows are judged alike, paths of any
    depth whole; an empty table gives no rows; other columns are ignored.
    """
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), *([] if labelled is None else [labelled.alias("given")]))
    ruled = parsed.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    by_rule = F.when(F.col("fit.verdict") == "block", 1).when(F.col("fit.verdict") == "allow", 0)
    ruled = ruled.withColumn("bad", by_rule if labelled is None else F.col("given").cast("int"))
    rows = ruled.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("ruling"), "bad")
    tree = materialize(templates(ruled.select("host", "path", "bad")))
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(tree, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "template", "purity"
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
