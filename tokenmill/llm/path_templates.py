"""URL filter over path-template trees.

Below each host, paths form a tree of segments, as deep as the paths are. Segments that vary
(numbers, hashes) become wildcards; sibling branches whose labelled share of blocked
pages does not differ from their parent's beyond chance are merged into the wildcard too. Each
template has a purity, its labelled share of blocked pages, smoothed towards its parent's, and
is rejected from a threshold on. Labels are the verdicts of explicit rules. Only DataFrame
functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.plans.joins import broadcast_up_to
from tokenmill.plans.session import cut_lineage

ANY, END = "*", "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without it."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of size, rule and verdict of the longest rule (host, path, verdict) that fits, or null.

    A rule fits its host and all subdomains where the path starts with the rule's. Of rules of
    one length the last by text wins.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    return F.array_max(F.array(*fits, none))


def generalised(segment: Column) -> Column:
    """Wildcard for numbers (with an extension, too) and for long hexadecimal names that hold a digit."""
    return F.when(
        segment.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$") | (segment.rlike(r"^[0-9a-fA-F-]{8,}$") & segment.rlike("[0-9]")), ANY
    ).otherwise(segment)


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url",
    depth: int = 3, z_limit: float = 1.96, strength: float = 4.0, threshold: float = 0.5,
) -> DataFrame:
    """Verdict of every page: page_id, host, path, rule, verdict, template, purity.

    A page under a rule takes the longest rule's verdict. Any other takes its template's: block
    where the smoothed purity is at least ``threshold``. Templates have at least ``depth`` segments
    (the end of a shorter path counts as such). From there on a template is parted further, segment by
    segment, as long as its pages have several shapes and one of them a further segment. A literal
    segment stays literal only if its share of blocked labels differs from the node's by ``z_limit``
    standard errors, however few of the node's pages it has. A node's labels count against
    ``strength`` pages of its parent's purity; the root is all hosts.

    Pages are summed to (host, path shape) before anything is shuffled, so a hot host costs one
    row for each task and shape. ``rules`` is a short list of the caller's.

    A null url, or one without ``://``, has an empty host and path and takes the template of that
    host. Repeated rows and null ids are kept. An empty table gives no rows. Other columns are
    not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    parts = F.filter(F.split("path", "/", -1), lambda s: s != "")
    rows = rows.withColumn("shape", F.transform(parts, generalised)).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("given"), "shape"
    )
    blocked = F.sum((F.col("given") == "block").cast("long"))
    nodes = cut_lineage(
        rows.groupBy("host", "shape").agg(
            F.count("given").alias("lab"), F.coalesce(blocked, F.lit(0)).alias("blk")
        ), "shapes",
    )
    everything = nodes.agg(F.sum("lab"), F.sum("blk"), F.max(F.size("shape"))).first()
    root = (everything[1] or 0) / everything[0] if everything[0] else 0.0
    smooth = lambda prior: (F.col("blk_in") + strength * prior) / (F.col("lab_in") + strength)
    sums = [F.sum("lab").alias("lab_in"), F.sum("blk").alias("blk_in")]

    hosts = nodes.groupBy("host").agg(*sums).select("host", smooth(F.lit(root)).alias("purity"))
    tree = nodes.join(hosts, "host").withColumn("template", F.lit(""))
    ended = []
    for level in range(max(depth, everything[2] or 0)):
        if level >= depth:
            # rows are one for each shape of a host
            deeper = (F.count("*") > 1) & (F.max(F.size("shape")) > level)
            parted = tree.join(tree.groupBy("host", "template").agg(deeper.alias("deeper")), ["host", "template"])
            parted = cut_lineage(parted, "templates")
            ended.append(parted.where(~F.col("deeper")).drop("deeper"))
            tree = parted.where("deeper").drop("deeper")
            if tree.isEmpty():
                break
        tree = tree.withColumn("step", F.coalesce(F.get("shape", level), F.lit(END)))
        children = tree.groupBy("host", "template", "step").agg(*sums)
        parents = children.groupBy("host", "template").agg(
            F.sum("lab_in").alias("lab_up"), F.sum("blk_in").alias("blk_up")
        )
        share = F.col("blk_up") / F.col("lab_up")
        error = F.sqrt(share * (1 - share) / F.col("lab_in"))
        unlike = (F.col("lab_in") > 0) & (error > 0) & (F.abs(F.col("blk_in") / F.col("lab_in") - share) >= z_limit * error)
        name = F.when((F.col("step") == ANY) | ~F.coalesce(unlike, F.lit(False)), ANY).otherwise(F.col("step"))
        name = F.when(F.col("step") == END, END).otherwise(name)
        named = children.join(parents, ["host", "template"]).select("host", "template", "step", name.alias("name"))
        tree = tree.join(named, ["host", "template", "step"])
        merged = tree.groupBy("host", "template", "name", F.col("purity").alias("above")).agg(*sums).select(
            "host", "template", "name", smooth(F.col("above")).alias("own")
        )
        tree = tree.join(merged, ["host", "template", "name"]).withColumns(
            {"purity": F.col("own"), "template": F.concat("template", F.lit("/"), "name")}
        ).drop("own", "name", "step")
        tree = cut_lineage(tree, "templates")
    tree = reduce(DataFrame.unionByName, [*ended, tree])
    known = broadcast_up_to(tree.select("host", "shape", "template", "purity"), BROADCAST_ROWS)
    verdict = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return rows.join(known, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", verdict).alias("verdict"), "template", "purity"
    )
