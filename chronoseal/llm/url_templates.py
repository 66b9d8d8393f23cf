"""URL filter: rules first, then a tree of path templates with smoothed labelled purity.

Urls of a host are cut into path segments. Numbers, hashes and the like become wildcards by their form; where a node
of the tree has many children that hardly repeat, these become one wildcard; children that repeat stay. Sibling branches whose labels do
not differ significantly from those of the whole family are merged. The purity of a branch is its share of bad pages,
smoothed towards that of its parent, and so on up to the host and all pages; a template that is too bad is rejected.

Urls are counted per template before anything else, so that the tree is built from counts. Each level takes a few
aggregations keyed by host and branch, combined before they are shuffled. Paths
of any depth are read to their last segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import stored

WIDE = 12
FRESH = 0.3
SUPPORT = 20
SMOOTHING = 20.0
SIMILAR = 1.96
LIMIT = 0.5


def host(url: Column) -> Column:
    """Part after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """Part after the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """Longest rule (``host/path``) that fits, and its verdict; null if none does. The last of equal rules counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def segments(path_: Column) -> Column:
    """All path segments, with numbers, hashes and dates as wildcards."""
    parts = F.filter(F.split(path_, "/"), lambda s: s != "")
    return F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9]+$"), F.lit("{n}"))
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{h}"))
        .otherwise(F.regexp_replace(s, r"[0-9]+", "{n}")),
    )


def template_tree(urls: DataFrame, wide: int = WIDE, fresh: float = FRESH, support: int = SUPPORT) -> DataFrame:
    """Templates of all urls: ``host, segs, template, n, labelled, bad``.

    ``urls`` has ``host``, ``segs`` and ``label`` (1 bad, 0 good, else null). ``template`` replaces the children of a node with
    fewer than ``support`` urls by ``*`` if there are at least ``wide`` of them and they are the share ``fresh`` or more of
    their urls. Other children stay as they are. A node above fewer than ``wide`` different paths opens nowhere, so the
    levels end once only such nodes are left, however deep their paths go on.
    """
    known = F.col("label").isin(0, 1)
    rows = urls.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count(F.when(known, 1)).alias("labelled"), F.coalesce(F.sum(F.when(known, F.col("label"))), F.lit(0)).cast("bigint").alias("bad")
    )
    rows = stored(rows.withColumn("template", F.array().cast("array<string>")), "templates")
    level = 0
    while True:
        child = F.get("segs", F.lit(level))
        deep = rows.where(F.size("segs") > level)
        nodes = deep.groupBy("host", "template", child.alias("child")).agg(F.sum("n").alias("n"), F.count("*").alias("paths"))
        nodes = stored(nodes, "nodes")
        if nodes.groupBy("host", "template").agg(F.sum("paths").alias("paths")).where(F.col("paths") >= wide).isEmpty():
            return rows.withColumn("template", F.concat("template", F.slice("segs", level + 1, F.size("segs"))))
        family = nodes.where(F.col("n") < support).groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("n"))
        open_ = family.where((F.col("children") >= wide) & (F.col("children") >= fresh * F.col("n")))
        open_ = stored(open_.select("host", "template", F.lit(True).alias("open")), "wildcards")
        frequent = nodes.where(F.col("n") >= support).select("host", "template", "child", F.lit(True).alias("frequent"))
        joined = rows.withColumn("child", child).join(open_, ["host", "template"], "left").join(frequent, ["host", "template", "child"], "left")
        step = F.when(F.col("open").isNotNull() & F.col("frequent").isNull(), F.lit("*")).otherwise(F.col("child"))
        grown = F.when(F.size("segs") > level, F.concat("template", F.array(step))).otherwise(F.col("template"))
        rows = stored(joined.withColumn("template", grown).drop("child", "open", "frequent"), "templates")
        level += 1


def purities(tree: DataFrame, smoothing: float = SMOOTHING, similar: float = SIMILAR) -> DataFrame:
    """Smoothed share of bad pages of each template: ``host, template, purity``.

    At each level a branch whose share lies within ``similar`` standard errors of its family's is counted with
    all such siblings, else alone.
    """
    total = tree.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).first()
    prior = (total["bad"] or 0) / max(1, total["labelled"] or 0)
    leaves = stored(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")), "leaves")
    smooth = lambda bad, n, base: (bad + smoothing * base) / (n + smoothing)
    hosts = leaves.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    branch = F.array().cast("array<string>")
    known = hosts.select("host", branch.alias("branch"), smooth(F.col("bad"), F.col("labelled"), F.lit(prior)).alias("purity"))
    done = leaves.where(F.size("template") == 0).join(known.select("host", "purity"), "host").select("host", "template", "purity")
    rest, level = leaves.where(F.size("template") > 0), 0
    while not rest.isEmpty():
        level += 1
        deep = rest.withColumn("branch", F.slice("template", 1, level)).withColumn("parent", F.slice("template", 1, level - 1))
        nodes = deep.groupBy("host", "parent", "branch").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count("*").alias("leaves"))
        family = nodes.groupBy("host", "parent").agg(F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
        share = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
        error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / F.greatest(F.col("labelled"), F.lit(1)))
        own = F.col("bad") / F.greatest(F.col("labelled"), F.lit(1))
        near = (F.col("labelled") == 0) | (F.abs(own - share) <= similar * error)
        # A branch that differs is its own group; the others of the family are one.
        grouped = nodes.join(family, ["host", "parent"]).withColumn("alone", F.when(~near, F.col("branch")))
        grouped = stored(grouped.select("host", "parent", "branch", "alone", "bad", "labelled", "leaves"), "branches")
        merged = grouped.where(F.col("alone").isNull()).groupBy("host", "parent").agg(F.sum("bad").alias("m_bad"), F.sum("labelled").alias("m_labelled"))
        above = known.select("host", F.col("branch").alias("parent"), F.col("purity").alias("base"))
        with_counts = grouped.join(merged, ["host", "parent"], "left").join(above, ["host", "parent"])
        bad = F.when(F.col("alone").isNull(), F.col("m_bad")).otherwise(F.col("bad"))
        labelled = F.when(F.col("alone").isNull(), F.col("m_labelled")).otherwise(F.col("labelled"))
        known = stored(with_counts.select("host", "branch", "leaves", smooth(bad, labelled, F.col("base")).alias("purity")), "purities")
        placed = stored(deep.join(known, ["host", "branch"]).select("host", "template", "bad", "labelled", "leaves", "purity"), "placed")
        # Below a branch with one leaf there is one child a level, so each further level smooths the leaf towards its own share.
        below = F.size("template") - level
        weight = F.pow(smoothing / (F.col("labelled") + smoothing), below)
        settled = F.when((below == 0) | (F.col("labelled") == 0), F.col("purity")).otherwise(own + weight * (F.col("purity") - own))
        ends = (below == 0) | (F.col("leaves") == 1)
        done = done.unionByName(placed.where(ends).select("host", "template", settled.alias("purity")))
        rest = placed.where(~ends).select("host", "template", "bad", "labelled")
    return done


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], limit: float = LIMIT) -> DataFrame:
    """Per row of ``pages`` (``page_id``, ``url``, ``label``): ``page_id, host, path, rule, verdict, template, purity``.

    ``label`` is 1 for bad, 0 for good, anything else unknown. Without a fitting rule the verdict is ``block`` if the
    purity of the template exceeds ``limit``. A null url, or one without ``://``, has empty host and path and is
    a template of its own. Repeated rows count as often as they stand there; no labels at all allow everything.
    """
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label")
    rows = rows.withColumn("segs", segments(F.col("path")))
    tree = template_tree(rows)
    scored = tree.select("host", "segs", "template").join(purities(tree), ["host", "template"])
    scored = stored(scored, "scored")
    rule, said = fitting_rule(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("purity") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(scored, ["host", "segs"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), F.array_join("template", "/").alias("template"), "purity"
    )
