"""Source paths: suffixes, match scores, module names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, SUFFIX, FILE_NAME, NONE = 3, 2, 1, 0


def src_suffix(path: Column) -> Column:
    """From the first ``/src/`` on, without the slash before it; else the whole path."""
    at = F.instr(path, "/src/")
    return F.when(at > 0, F.substr(path, at + 1)).otherwise(path)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def same_suffix(a: Column, b: Column) -> Column:
    """Whether one path ends with the other; an empty path fits none."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.endswith(a, b) | F.endswith(b, a))


def score(a: Column, b: Column) -> Column:
    """How well paths match: 3 equal, 2 one ends with the other, 1 same file name, 0 not; an empty path fits none."""
    return F.when(a == b, EXACT).when(same_suffix(a, b), SUFFIX).when((file_name(a) == file_name(b)) & (file_name(a) != ""), FILE_NAME).otherwise(NONE)


def _tails(df: DataFrame, path: str, other: DataFrame, named: str) -> DataFrame:
    """``df`` with __tail, one row for each ending of ``path`` that is as long as some path of ``other`` and shorter than
    the path itself: by these two paths of which one ends with the other meet as equals."""
    lengths = other.agg(F.collect_set(F.length(named))).scalar()  # as many as there are lengths of paths
    long = df.withColumn("__n", F.explode(lengths)).where((F.col("__n") > 0) & (F.col("__n") < F.length(path)))
    return long.withColumn("__tail", F.right(F.col(path), F.col("__n"))).drop("__n")


def best_match(left: DataFrame, right: DataFrame, row: str, path: str, wanted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each left row with the right path (of the same ``keys``) that matches best (least path on ties).

    Each way to match is an equi-join with one right path for each ending or file name, so rows stay as many as there are
    paths, however many of them share a file name."""
    a = left.select(*keys, path).where(F.length(path) > 0).distinct()
    b = right.select(*keys, wanted).where(F.length(wanted) > 0).distinct()
    least = F.min(wanted).alias(wanted)
    same = lambda c: [*[F.col(k) for k in keys], F.col(c).alias("__by")]
    exact = b.select(*same(wanted), wanted)
    longer = _tails(b, wanted, a, path).groupBy(*same("__tail")).agg(least)
    shorter = _tails(a, path, b, wanted).select(*keys, path, F.col("__tail").alias("__by")).join(exact, [*keys, "__by"])
    names = b.withColumn("__name", file_name(F.col(wanted))).where("__name <> ''").groupBy(*same("__name")).agg(least)
    own = a.withColumn("__by", F.col(path))
    found = [
        own.join(exact, [*keys, "__by"]).select(*keys, path, wanted, F.lit(EXACT).alias("score")), own.join(longer, [*keys, "__by"]).select(*keys, path, wanted, F.lit(SUFFIX).alias("score")),
        shorter.select(*keys, path, wanted, F.lit(SUFFIX).alias("score")), a.withColumn("__by", file_name(F.col(path))).join(names, [*keys, "__by"]).select(*keys, path, wanted, F.lit(FILE_NAME).alias("score")),
    ]
    best = reduce(DataFrame.union, found).groupBy(*keys, path).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(wanted).alias("w"))).alias("b"))
    return left.select(*keys, row, path).join(best, [*keys, path]).select(*keys, row, F.col("b.w").alias(wanted), (-F.col("b.s")).alias("score"))


def matching(left: DataFrame, right: DataFrame, path: str, wanted: str) -> DataFrame:
    """All distinct pairs (path, wanted) of which one ends with the other or that are equal from ``/src/`` on, by equi-joins
    on endings."""
    a, b = left.select(path).where(F.length(path) > 0).distinct(), right.select(wanted).where(F.length(wanted) > 0).distinct()
    whole = lambda df, c: df.withColumn("__tail", F.col(c))
    equal_or_longer = _tails(a, path, b, wanted).unionByName(whole(a, path)).join(whole(b, wanted), "__tail")
    shorter = whole(a, path).join(_tails(b, wanted, a, path), "__tail")
    inner = a.withColumn("__tail", src_suffix(F.col(path))).join(b.withColumn("__tail", src_suffix(F.col(wanted))), "__tail")
    return reduce(DataFrame.union, [x.select(path, wanted) for x in (equal_or_longer, shorter, inner)]).distinct()


def module_path(path: Column) -> Column:
    """``a/src/x/y.rs`` -> ``x::y``; a ``mod`` or ``lib`` file stands for its folder or the crate."""
    plain = F.translate(path, "\\", "/")
    inner = F.when(F.contains(plain, F.lit("/src/")), F.regexp_replace(plain, "^.*?/src/", "")).otherwise(F.regexp_replace(plain, "^src/", ""))
    bare = F.regexp_replace(inner, r"\.rs$", "")
    return F.replace(F.when(bare.isin("mod", "lib"), "").otherwise(F.regexp_replace(bare, "/mod$", "")), F.lit("/"), F.lit("::"))


def short_module(module: Column) -> Column:
    """The first part of a module; of ``specs::x_specs`` it is ``x``."""
    parts = F.split(module, "::")
    return F.when((F.get(parts, F.lit(0)) == "specs") & (F.size(parts) > 1), F.regexp_replace(F.get(parts, F.lit(1)), "_specs$", "")).otherwise(F.get(parts, F.lit(0)))


def sub_module(module: Column) -> Column:
    """For backends the first part that isn't ``serial``; else the short module."""
    inner = F.filter(F.slice(F.split(module, "::"), 2, 1000), lambda x: x != "serial")
    return F.when(F.split(module, "::")[0] == "backend", F.coalesce(F.get(inner, F.lit(0)), F.lit("backend"))).otherwise(short_module(module))


def entry_id(module: Column, name: Column, display: Column) -> Column:
    """An identifier for a page: module and name, or the display name where that says more."""
    base = F.when(module == "", name).otherwise(F.concat(F.replace(module, F.lit("::"), F.lit("__")), F.lit("__"), name))
    shown = F.replace(F.lower(display), F.lit("::"), F.lit("__"))
    generic = F.translate(F.translate(shown, "<", "_"), "> ", "")
    return F.when(F.contains(display, F.lit("<")), generic).when(F.contains(display, F.lit("::")) & ~F.contains(base, F.lower(name)), shown).otherwise(F.lower(base))


def source_link(base: str, path: Column, line: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", ""), F.lit("#L"), line.cast("string"))


def project_prefix(source: str) -> str:
    """``x/project/src`` -> ``project/src``, the prefix of links into a project; empty for other folders."""
    parts = source.replace("\\", "/").rstrip("/").split("/")
    return f"{parts[-2]}/src" if len(parts) > 2 and parts[-1] == "src" else ""
