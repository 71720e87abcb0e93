"""URL filters on DataFrame operations alone: rules first, then a tree of path templates for each host.

Segments of a path that are numbers or hexadecimal ids are wildcards at once. Level by level, a node with many different
children for its pages becomes a wildcard too (generalising), and so do children whose labelled pages don't differ from
their siblings' by a two-proportion test (merging). Templates are judged by the smoothed share of rejected pages among
their labelled ones. All work is aggregations by (host, template, segment), which combine in the map tasks, and joins back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ._common import written

MIN_CHILDREN = 12
PRIOR = 0.2
STRENGTH = 4.0
Z = 2.0


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; empty where there is no `://` or no url."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (`host/path` -> allow or block) that fits, or null: the host or a subdomain, and the path's start."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        out = F.when(((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start)), F.lit(rule)).otherwise(out)
    return out


def segment_type(segment: Column) -> Column:
    """Numbers and hexadecimal ids of eight digits or more become wildcards, with their file ending kept."""
    s = F.regexp_replace(segment, r"^[0-9]+(\.[a-z]+)?$", r"{n}$1")
    return F.regexp_replace(s, r"^[0-9a-f]{8,}(\.[a-z]+)?$", r"{h}$1")


def _segments_alike(a: Column, b: Column) -> Column:
    """How many segments two lists have in common at their start."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(a)).cast("int")


def _jumped(at: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that have their template, rows with the `child` that their node branches into), after runs without a branch.

    As far as all paths of a node go on alike, or end, there is nothing to decide: the node takes over these segments at
    once. A node's longest path tells how far that is: up to the first segment in which another path goes another way.
    """
    rest = F.slice("shape", F.col("depth") + 1, F.size("shape"))
    longest = at.groupBy("host", "template").agg(F.max(F.struct(F.size("shape").alias("size"), rest.alias("rest")))["rest"].alias("longest"))
    at = at.join(longest, ["host", "template"]).withColumn("alike", _segments_alike(rest, F.col("longest")))
    leaves = F.col("alike") < F.size("shape") - F.col("depth")
    nearest = at.groupBy("host", "template").agg(F.min(F.when(leaves, F.col("alike"))).alias("run"))
    at = at.join(nearest, ["host", "template"]).withColumn("run", F.least(F.coalesce("run", F.size("longest")), F.size("shape") - F.col("depth")))
    run = F.array_join(F.slice("shape", F.col("depth") + 1, F.col("run")), "/")
    at = at.withColumn("template", F.when(F.col("run") > 0, F.concat("template", F.lit("/"), run)).otherwise(F.col("template")))
    at = written(at.withColumn("depth", F.col("depth") + F.col("run")).select(*names, "depth"), "runs")
    ended = F.size("shape") <= F.col("depth")
    return at.where(ended), at.where(~ended).withColumn("child", F.get("shape", F.col("depth")))


def templates(urls: DataFrame, min_children: int = MIN_CHILDREN, z: float = Z) -> DataFrame:
    """(host, shape, n, good, bad, template) for a table (host, shape, n, good, bad), shape being the list of typed segments.

    One pass for each branch on the way to a path, root first: a path that leaves all others has its template at once,
    however long it is. A node is wide if it has at least `min_children` (two or more) different children and they are over a
    fifth of its pages. Under a wide node every child is generalised; else a child with labels is merged into the wildcard
    when its share of rejected pages is within `z` standard errors of all its siblings', and one without labels stays. A path
    without segments has an empty template; repeated rows are told apart by the caller; an empty table gives an empty result.
    """
    names = ["host", "shape", "n", "good", "bad", "template"]
    at = written(urls.select("host", "shape", "n", "good", "bad", F.lit("").alias("template"), F.lit(0).alias("depth")), "places")
    done = []
    while not at.isEmpty():
        ended, at = _jumped(at, names)
        done.append(ended.select(names))
        kids = at.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        tops = kids.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("all_n"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
        kids = kids.join(tops, ["host", "template"])
        labelled, every = F.col("good") + F.col("bad"), F.col("all_good") + F.col("all_bad")
        mean, own = F.col("all_bad") / F.when(every > 0, every), F.col("bad") / F.when(labelled > 0, labelled)
        # Within z standard errors: squared, so that no root is taken.
        alike = (own - mean) * (own - mean) * labelled <= z * z * mean * (1 - mean)
        wide = (F.col("kinds") >= max(2, min_children)) & (F.col("kinds") * 5 >= F.col("all_n"))
        merged = wide | ((F.col("kinds") > 1) & F.coalesce(alike & (mean > 0) & (mean < 1), F.lit(False)))
        kids = kids.select("host", "template", "child", F.concat("template", F.lit("/"), F.when(merged, F.lit("*")).otherwise(F.col("child"))).alias("next"))
        at = at.join(kids, ["host", "template", "child"]).drop("template").withColumnRenamed("next", "template")
        at = written(at.withColumn("depth", F.col("depth") + 1).select(*names, "depth"), "branches")
    return reduce(DataFrame.unionByName, done) if done else at.select(names)


def judge(pages: DataFrame, rules: dict[str, str], min_children: int = MIN_CHILDREN, z: float = Z, prior: float = PRIOR, strength: float = STRENGTH) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every page.

    Pages that a rule judges are the labelled ones. Other pages get their template's verdict: block where
    (rejected + strength * prior) / (labelled + strength) is above a half. A null or malformed url has an empty host and
    path and template; repeated rows count each; an empty table gives an empty result. Only page_id and url are read.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = p.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        given = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(given)
    p = p.withColumn("given", given).withColumn("shape", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_type))
    p = p.withColumn("place", F.array_join("shape", "/"))
    counted = p.groupBy("host", "place").agg(F.first("shape").alias("shape"), F.count("*").alias("n"), F.count_if(F.col("given") == "allow").alias("good"), F.count_if(F.col("given") == "block").alias("bad"))
    tree = templates(counted, min_children, z)
    pure = tree.groupBy("host", "template").agg(((F.sum("bad") + F.lit(strength * prior)) / (F.sum("good") + F.sum("bad") + F.lit(strength))).alias("purity"))
    known = tree.select("host", F.array_join("shape", "/").alias("place"), "template").join(pure, ["host", "template"])
    out = p.join(known, ["host", "place"])
    verdict = F.coalesce("given", F.when(F.col("purity") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
