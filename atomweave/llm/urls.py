"""URL filters by a tree of path templates, with DataFrame functions alone.

Rules judge the urls they fit.  These judged urls are the labels from which every host's template tree learns what to
say of the others.  Level by level, path segments that are rare under their parent become the wildcard ``*``; labelled
branches whose labels don't differ significantly (chi-square) from those of their siblings are merged into ``~``, while
branches without labels, of which nothing is known, stay apart.  A url's template is rejected if the share of its
labels that say block, smoothed by SMOOTHING labels of either kind, reaches REJECT; so none is without evidence.

All levels work on sums that tasks add up before they are dealt out, so a host of a third of all urls is a few rows.

Defined results: a null url, or one without ``://``, has empty host and path and falls into one template; urls of
templates without labels are allowed.  Repeated urls count as often as they occur.
Input columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import BROADCAST_ROWS, staged

#: Levels of the tree; what is deeper belongs to the last one.
DEPTH = 3
#: A segment stays literal from so many urls on, and from this part (1 / LEAST_PART) of its parent's.
LEAST_URLS, LEAST_PART = 3, 50
#: Chi-square above which a branch differs from its siblings (5 %).
DIFFERS = 3.84
#: Labels of either kind added to a template's own, and the share of block labels that rejects it.
SMOOTHING, REJECT = 1.0, 0.7

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule (``host/path``, verdict) that fits as a struct, or null; rules are a short list."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows and else to be shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _level(rows: DataFrame, segment: str) -> DataFrame:
    """``rows`` with ``node`` one level deeper: by literal, wildcard or merged branch."""
    sums = [F.sum(c).alias(c) for c in ("n", "b", "m")]
    children = staged(rows.groupBy("host", "node", F.col(segment).alias("part")).agg(F.count("*").alias("n"), F.sum("block").alias("b"), F.sum("labelled").alias("m")))
    parents = children.groupBy("host", "node").agg(*sums)
    at = ["host", "node"]
    literal = children.join(parents.select(*at, F.col("n").alias("n_all")), at).where((F.col("n") >= LEAST_URLS) & (F.col("n") * LEAST_PART >= F.col("n_all"))).drop("n_all")
    taken = literal.groupBy(*at).agg(*[F.sum(c).alias("l" + c) for c in "nbm"])
    rest = parents.join(taken, at, "left").select(*at, F.lit(None).cast("string").alias("part"), *[(F.col(c) - F.coalesce("l" + c, F.lit(0))).alias(c) for c in "nbm"])
    n, k, b, total = (F.col(c).cast("double") for c in ("m", "m_all", "b", "b_all"))
    apart = (b * k - total * n) * (b * k - total * n) * k > F.lit(DIFFERS) * n * (k - n) * total * (k - total)
    branches = literal.unionByName(rest).join(parents.select(*at, F.col("b").alias("b_all"), F.col("m").alias("m_all")), at)
    named = staged(branches.select(*at, "part", F.when(apart | (F.col("m") == 0), F.coalesce("part", F.lit("*"))).otherwise("~").alias("label")))
    lit = named.where(F.col("part").isNotNull()).select(*at, F.col("part").alias(segment), F.col("label").alias("own"))
    other = named.where(F.col("part").isNull()).select(*at, F.col("label").alias("wild"))
    deeper = rows.join(_small(lit), [*at, segment], "left").join(_small(other), at, "left")
    return deeper.withColumn("node", F.concat("node", F.lit("/"), F.coalesce("own", "wild"))).drop("own", "wild", segment)


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` without the url, with host, path, rule, verdict, template and purity."""
    made = ("host", "path", "rule", "verdict", "template", "purity")
    keep = [c for c in pages.columns if c not in (*made, url)]
    host, path = parts(F.col(url))
    rows = pages.select(F.struct(*keep).alias("keep") if keep else F.lit(None).alias("keep"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(rules, F.col("host"), F.col("path"))).withColumns({"labelled": F.col("r").isNotNull().cast("long"), "block": F.coalesce(F.col("r.verdict") == "block", F.lit(False)).cast("long"), "node": F.lit("")})
    segments = F.split("path", "/")
    for d in range(1, DEPTH + 1):
        own = F.get(segments, F.lit(d)) if d < DEPTH else F.array_join(F.slice(segments, DEPTH + 1, F.greatest(F.size(segments), F.lit(1))), "/")
        rows = _level(rows.withColumn("segment", F.coalesce(own, F.lit(""))), "segment")
    leaves = staged(rows.groupBy("host", "node").agg(F.sum("block").alias("b"), F.sum("labelled").alias("m")))
    purity = (F.col("b").cast("double") + SMOOTHING) / (F.col("m").cast("double") + 2 * SMOOTHING)
    rows = rows.join(_small(leaves.select("host", "node", purity.alias("purity"))), ["host", "node"], "left")
    kept = [F.col(f"keep.`{c}`") for c in keep]
    return rows.select(*kept, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), F.concat("host", "node").alias("template"), "purity")
