"""Classification by rules that are data: all criteria of a rule must hold, any entry of a criterion's list will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.operators import joins

#: Criterion -> (column it looks at, how).  "in": equals an entry; "holds": text contains an entry; "calls": an element of
#: an array contains an entry; "is": equals a boolean; "empty": whether an array is empty.
CRITERIA: dict[str, tuple[str, str]] = {
    "mode": ("mode", "in"),
    "context": ("context", "in"),
    "name_contains": ("name", "holds"),
    "path_contains": ("file", "holds"),
    "has_ensures": ("has_ensures", "is"),
    "has_requires": ("has_requires", "is"),
    "has_decreases": ("has_decreases", "is"),
    "has_trusted_assumption": ("has_trusted_assumption", "is"),
    "ensures_calls_empty": ("ensures_calls", "empty"),
    "requires_calls_empty": ("requires_calls", "empty"),
    "ensures_calls_contain": ("ensures_calls", "calls"),
    "requires_calls_contain": ("requires_calls", "calls"),
    "ensures_calls_full_contain": ("ensures_calls_full", "calls"),
    "requires_calls_full_contain": ("requires_calls_full", "calls"),
    "ensures_fn_calls_contain": ("ensures_fn_calls", "calls"),
    "requires_fn_calls_contain": ("requires_fn_calls", "calls"),
    "ensures_method_calls_contain": ("ensures_method_calls", "calls"),
    "requires_method_calls_contain": ("requires_method_calls", "calls"),
}

RULE_SCHEMA = "pos int, label string, description string, trust string, " + ", ".join(f"c_{name} {'boolean' if how in ('is', 'empty') else 'array<string>'}" for name, (_, how) in CRITERIA.items())


def without_stop_words(df: DataFrame, stop_words: Sequence[str], columns: Sequence[str] = ("ensures_calls", "requires_calls")) -> DataFrame:
    """``df`` with the stop words taken out of its call lists; repeated calls stay."""
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return df.withColumns({c: F.filter(c, lambda x: ~F.array_contains(stop, x)) for c in columns if c in df.columns})


def passes(criterion: str, wanted: Column) -> Column:
    """Whether a row meets a criterion; null where the rule doesn't set it."""
    column, how = CRITERIA[criterion]
    own = F.col(column)
    if how == "in":
        held = F.coalesce(F.array_contains(wanted, own), F.lit(False))
    elif how == "holds":
        held = F.exists(wanted, lambda p: F.contains(F.coalesce(own, F.lit("")), p))
    elif how == "calls":
        held = F.exists(F.coalesce(own, F.array().cast("array<string>")), lambda c: F.exists(wanted, lambda p: F.contains(c, p)))
    elif how == "empty":
        held = (F.coalesce(F.size(own), F.lit(0)) <= 0) == wanted
    else:
        held = F.coalesce(own, F.lit(False)) == wanted
    return F.when(wanted.isNotNull(), held)


#: Rules up to which each row is simply compared with all of them.
FEW_RULES = 64


def _all_hold(own: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in own:
        out = out & F.coalesce(passes(c, F.col(f"c_{c}")), F.lit(True))
    return out


def _own(df: DataFrame, rules: DataFrame, criteria: Sequence[str] | None) -> list[str]:
    return [c for c in (criteria or CRITERIA) if f"c_{c}" in rules.columns and CRITERIA[c][0] in df.columns]


def apply_rules(df: DataFrame, rules: DataFrame, criteria: Sequence[str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """``df`` times the rules that match, with pos and label.  Few rules go to all tasks; of many, if ``keys`` tell the rows
    apart, each row meets those alone that an index says may match."""
    own, told = _own(df, rules, criteria), [x for x in rules.columns if x not in ("pos", "label")]
    if keys is None or rules.count() <= FEW_RULES:
        return df.join(F.broadcast(rules), _all_hold(own)).drop(*told)
    met = _candidates(df, rules, own, keys).join(df, list(keys)).join(rules, "pos")
    return met.where(_all_hold(own)).select(*df.columns, "pos", "label")


def _candidates(df: DataFrame, rules: DataFrame, own: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, pos): rows and rules whose telling criterion holds.

    A rule is filed under one criterion, the first that it sets of: entries of call lists, parts of names and paths, values.
    Distinct values and distinct entries meet, parts by the letters that they share, so no row meets a rule that it has
    nothing in common with.  Rules that only ask for flags meet all rows, as many of these match."""
    order = [c for kind in ("calls", "holds", "in") for c in own if CRITERIA[c][1] == kind]
    filed = rules.withColumn("__under", F.coalesce(*[F.when(F.col(f"c_{c}").isNotNull(), c) for c in order], F.lit("")))
    filed = filed.select("pos", "__under", *[f"c_{c}" for c in order])
    out = df.select(*keys).join(F.broadcast(filed.where("__under = ''").select("pos")), F.lit(True))
    for c in order:
        column, how = CRITERIA[c]
        entries = filed.where(F.col("__under") == c).select("pos", F.explode(F.array_distinct(f"c_{c}")).alias("entry"))
        values = F.explode(F.array_distinct(column)) if how == "calls" else F.col(column)
        held = df.select(*keys, values.alias("value")).where("value IS NOT NULL")
        if how == "in":
            pairs = held.join(entries, held["value"] == entries["entry"])
        else:
            texts, parts = held.select("value").distinct(), entries.select("entry").distinct()
            found = joins.contained(texts.select(F.col("value").alias("v"), "value"), "v", "value", parts.select(F.col("entry").alias("e"), "entry"), "e", "entry")
            # an empty entry is in every value
            found = found.select(F.col("v").alias("value"), F.col("e").alias("entry")).unionByName(texts.join(F.broadcast(parts.where("entry = ''").limit(1)), F.lit(True)).select("value", "entry"))
            pairs = held.join(found, "value").join(entries, "entry")
            if how == "holds":  # and in a name or path that isn't there
                none = df.where(F.col(column).isNull()).select(*keys)
                pairs = pairs.select(*keys, "pos").unionByName(none.join(F.broadcast(entries.where("entry = ''").select("pos")), F.lit(True)).select(*keys, "pos"))
        out = out.unionByName(pairs.select(*keys, "pos"))
    return out.distinct()


def labels(df: DataFrame, rules: DataFrame, keys: Sequence[str], criteria: Sequence[str] | None = None) -> DataFrame:
    """``df`` with spec_labels: the labels of its matching rules in rule order, repeated ones kept."""
    found = apply_rules(df, rules, criteria, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("spec_labels"))
    return df.join(found, list(keys), "left").withColumn("spec_labels", F.coalesce("spec_labels", F.array().cast("array<string>")))


def explain(df: DataFrame, rules: DataFrame, keys: Sequence[str], criteria: Sequence[str] | None = None) -> DataFrame:
    """(keys, pos, label, criterion, passed) for every criterion that a rule sets, and whether all of that rule's hold."""
    own = _own(df, rules, criteria)
    results = F.filter(F.array(*[F.struct(F.lit(c).alias("criterion"), passes(c, F.col(f"c_{c}")).alias("passed")) for c in own]), lambda x: x["passed"].isNotNull())
    rows = df.crossJoin(F.broadcast(rules)).withColumn("results", results)
    return rows.select(*keys, "pos", "label", F.forall("results", lambda x: x["passed"]).alias("matched"), F.inline("results"))
