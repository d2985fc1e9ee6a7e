"""URL verdicts from rules and from a tree of path templates, in DataFrame operations only.

A rule names a host and a path prefix and fits the host, its subdomains and every path that starts with its path; the
longest fitting rule decides. What no rule decides is judged by its template. Per host, the path becomes a branch of at
most ``DEPTH`` segments, and level by level a segment turns into a wildcard

* by its shape: digits, and names with digits in them, are variable;
* by its support: a branch with fewer than ``SUPPORT`` urls below its node is variable, written ``*``, or ``?`` where none of them has a label;
* by its labels: branches whose share of bad labels does not differ from their node's by ``DEVIATIONS`` standard deviations are
  similar and become one, written ``+``. A branch that alone holds all labels of its node has none to be similar to, and
  where all labels of a node are alike there is no deviation to judge by; such branches keep their names. So a branch
  without labels never shares a template with a labelled one.

A template is rejected when its smoothed share of bad labels exceeds ``REJECT``. The smoothing adds two urls of even odds, and
counts each url without label as ``UNLABELLED`` of one with even odds; so few labels do not condemn many unknown urls, and a
template without labels is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.shared import free_name, written

DEPTH = 4
SUPPORT = 8
DEVIATIONS = 2.0
REJECT = 0.8
UNLABELLED = 0.5
MAX_RULES = 1000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null. ``rules`` are (verdict, host/path) in plain text.

    Rules are part of the expression, so their number is bounded; of equally long ones the first listed wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        chosen = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def segments(path: Column, depth: int = DEPTH) -> list[Column]:
    """The first ``depth`` segments by shape, null beyond the end; deeper ones fold into the last as ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def shaped(s):
        return (F.when(s.rlike(r"\A[0-9]+\z"), "<n>")
                .when(s.rlike(r"\A[0-9]+\.[A-Za-z0-9]+\z"), F.concat(F.lit("<n>."), F.regexp_extract(s, r"\.([^.]*)\z", 1)))
                .when(s.rlike("[0-9]"), "<id>").otherwise(s))

    found = [F.get(parts, F.lit(i)) for i in range(depth)]
    return [*[shaped(s) for s in found[:-1]],
            F.when(F.size(parts) > depth, "**").otherwise(shaped(found[-1]))]


def templates(urls: DataFrame, depth: int = DEPTH, support: int = SUPPORT, deviations: float = DEVIATIONS) -> DataFrame:
    """``(host, s0.., template, urls, labelled, bad)`` for every shape of path in ``urls (host, path, label)``.

    ``label`` is true for bad, false for good, null for unknown. Counting by shape comes first, so a host with a third of
    all urls leaves each task as one row per shape; each level then needs a count by node and segment, and one by node.
    """
    names = [f"s{i}" for i in range(depth)]
    shapes = (
        urls.select("host", *[c.alias(n) for c, n in zip(segments(F.col("path"), depth), names)], "label")
        .groupBy("host", *names)
        .agg(F.count(F.lit(1)).alias("urls"), F.count("label").alias("labelled"), F.count_if("label").alias("bad")))
    tree = written(shapes.withColumn("node", F.lit("")), "url-shapes")
    sums = [F.sum(c).alias(c) for c in ("urls", "labelled", "bad")]
    for name in names:
        branches = tree.groupBy("host", "node", name).agg(*sums)
        whole = branches.groupBy("host", "node").agg(
            F.sum("labelled").alias("node_labelled"), F.sum("bad").alias("node_bad"))
        share = F.try_divide("node_bad", "node_labelled")
        near = (F.abs(F.try_divide("bad", "labelled") - share)
                <= deviations * F.sqrt(F.try_divide(share * (1 - share), F.col("labelled"))))
        # Without labels nothing tells a branch apart by them, and its name stays.
        similar = (F.col("labelled") < F.col("node_labelled")) & (share > 0) & (share < 1) & near
        rare = F.when(F.col("labelled") > 0, "*").otherwise("?")
        step = F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("/"), F.when(F.col("urls") < support, rare).when(
            F.coalesce(similar, F.lit(False)), "+").otherwise(F.col(name))))
        judged = branches.join(whole, ["host", "node"]).select("host", "node", name, step.alias("step"))
        judged = judged.withColumnsRenamed({"host": "b_host", "node": "b_node", name: "b_name"})
        same = ((tree["host"] == judged["b_host"]) & (tree["node"] == judged["b_node"])
                & tree[name].eqNullSafe(judged["b_name"]))
        grown = tree.join(judged, same).withColumn("node", F.concat("node", "step"))
        tree = written(grown.select(*tree.columns), "url-tree")
    totals = tree.groupBy("host", "node").agg(*sums)
    totals = totals.withColumnsRenamed({"host": "t_host", "node": "t_node"})
    return (tree.drop("labelled", "bad", "urls").join(totals, (tree["host"] == totals["t_host"]) & (tree["node"] == totals["t_node"]))
            .select("host", *names, F.col("node").alias("template"), "urls", "labelled", "bad"))


def purity(urls: Column, labelled: Column, bad: Column) -> Column:
    unknown = (urls - labelled) * UNLABELLED
    return (bad + unknown / 2 + 1) / (labelled + unknown + 2)


def judge(pages: DataFrame, rules: list[tuple[str, str]], label: Column | None = None, url_col="url",
          depth: int = DEPTH, reject: float = REJECT) -> DataFrame:
    """All rows and columns, with ``host``, ``path``, ``rule``, ``template`` and ``verdict`` (allow or block).

    ``label`` tells bad urls (true) from good ones (false) where it is known; by default the verdict of the rules.
    Older columns of these names are replaced. A null url or one without ``://`` has an empty host and path, and is judged
    by the template of the empty host.
    """
    host, path, found = (free_name(pages, n) for n in ("host", "path", "found"))
    seen = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    seen = seen.withColumn(found, longest_rule(F.col(host), F.col(path), rules))
    known = F.col(found)["verdict"] == "block" if label is None else label
    tree = templates(seen.select(F.col(host).alias("host"), F.col(path).alias("path"), known.alias("label")), depth)
    tree = written(tree, "url-templates")
    rejected = purity(F.col("urls"), F.col("labelled"), F.col("bad")) > reject
    names = [f"s{i}" for i in range(depth)]
    leaves = tree.select(F.struct("host", *names).alias("leaf"), F.col("template").alias("leaf_template"),
                         F.when(rejected, "block").otherwise("allow").alias("leaf_verdict"))
    # Null segments compare as equal inside the struct's text form, so the join has one plain key.
    leaves = leaves.withColumn("leaf", F.to_json("leaf"))
    own = F.to_json(F.struct(F.col(host).alias("host"), *[c.alias(n) for c, n in zip(segments(F.col(path), depth), names)]))
    joined = seen.join(leaves, own == leaves["leaf"], "left")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "verdict")]
    return joined.select(
        *kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col(found)["rule"].alias("rule"),
        F.col("leaf_template").alias("template"),
        F.coalesce(F.col(found)["verdict"], "leaf_verdict", F.lit("allow")).alias("verdict"))
