"""Specifications: labelled functions by atom, the spec browser's tables, and the tracked list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.functions import paths, text
from atomweave.functions.symbols import LINE_TOLERANCE
from atomweave.operators import closure, grouping, joins, rules
from atomweave.plans.verifylog import match_atoms

#: How prose begins, and words that don't make a formula prose.
_PROSE = r"(?i)^(this|the|it|we|for|if|when|note|see|returns|computes|checks|ensures|requires|proves|helper|verify|convert|used|should|must|can)\b"
_MATH = ("sqrt", "mod", "pow", "spec", "nat", "int", "bool", "field", "scalar", "point", "limb", "byte", "bits")


def catalog(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("name").isNotNull()).withColumn("module_path", paths.module_path(F.col("file")))


def summary(functions: DataFrame) -> DataFrame:
    return functions.agg(F.count("name").alias("total_functions"), F.count_distinct("file").alias("total_files"), F.count("parse_error").alias("failed_files"))


def names(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("name").isNotNull()).select("name").distinct().orderBy("name")


def by_file(functions: DataFrame) -> DataFrame:
    """(file, functions): the name and first line of each file's functions, in order of lines."""
    named = functions.where(F.col("name").isNotNull())
    return named.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("lines_start", "name"))), lambda f: F.struct(f["name"].alias("name"), f["lines_start"].alias("line"))).alias("functions"))


def is_proved() -> Column:
    """Whether a function counts as proved."""
    return (F.col("specified") | F.col("is_external_body")) & ~(F.col("has_trusted_assumption") | F.col("is_external_body") | F.col("has_no_decreases_attr"))


def matches(functions: DataFrame, atoms: DataFrame) -> DataFrame:
    """One row (matched, unmatched): functions that have an atom and that have none, before those of one atom overwrite each other."""
    own = catalog(functions)
    matched = match_atoms(own, atoms, LINE_TOLERANCE).agg(F.count("*").alias("matched"))
    return own.agg(F.count("*").alias("n")).crossJoin(matched).select("matched", (F.col("n") - F.col("matched")).alias("unmatched"))


def specified(functions: DataFrame, atoms: DataFrame, rule_rows: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """The functions that have an atom, keyed by its name (the last one of a name stays), with spec_labels."""
    own = match_atoms(catalog(functions), atoms, LINE_TOLERANCE)
    out = grouping.keep_last(own, ["code_name"], [F.col("file"), F.col("lines_start")])
    if rule_rows is None:
        return out
    judged = rules.without_stop_words(out, stop_words or [])
    return out.join(rules.labels(judged, rule_rows, ["code_name"]).select("code_name", "spec_labels"), "code_name", "left")


def coverage(labelled: DataFrame) -> DataFrame:
    has = F.size("spec_labels") > 0
    return labelled.agg(F.count_if("specified").alias("specified"), F.count_if(F.col("specified") & has).alias("specified_labelled"), F.count_if(has).alias("labelled"), text.percent(F.count_if(F.col("specified") & has), F.count_if("specified")).alias("percent"))


def math_interpretation(doc: Column) -> Column:
    """The first line of a comment that is a formula rather than prose, or an empty text."""
    words = lambda x: F.filter(F.regexp_extract_all(x, F.lit("[a-zA-Z]{4,}"), F.lit(0)), lambda w: ~F.lower(w).isin(*_MATH))
    formula = lambda x: (F.contains(x, F.lit("=")) | F.contains(x, F.lit("≡"))) & ~x.rlike(_PROSE) & (F.octet_length(x) <= 100) & (F.size(words(x)) <= 4)
    return F.coalesce(text.first_line(F.coalesce(doc, F.lit("")), formula), F.lit(""))


def clause_lines(c: Column) -> Column:
    """The lines of a clause without its keyword."""
    return F.coalesce(text.clauses(F.regexp_replace(text.strip(c), "^(requires|ensures)", "")), F.array().cast("array<string>"))


def references(functions: DataFrame, spec_names: DataFrame) -> DataFrame:
    """(file, lines_start, name, spec): specs that a function calls in its clauses or whose name stands in their text."""
    key = ["file", "lines_start", "name"]
    called = functions.select(*key, F.explode(F.concat("ensures_calls", "requires_calls")).alias("spec")).join(spec_names, "spec", "left_semi")
    texts = functions.select(F.struct(*key).alias("k"), F.concat_ws("\n", "requires_text", "ensures_text").alias("t"))
    shown = joins.contained(texts, "k", "t", spec_names.withColumn("needle", F.col("spec")), "spec", "needle").select("k.*", "spec")
    return called.unionByName(shown).distinct()


def body_references(functions: DataFrame, spec_names: DataFrame) -> DataFrame:
    """(file, lines_start, name, spec): other specs whose name and an opening bracket stand in a function's body."""
    texts = functions.where(F.col("body_text").isNotNull()).select(F.struct("file", "lines_start", "name").alias("k"), "body_text")
    met = joins.contained(texts, "k", "body_text", spec_names.withColumn("needle", F.concat("spec", F.lit("("))), "spec", "needle")
    return met.where(F.col("spec") != F.col("k.name")).select("k.*", "spec").distinct()


def browser(functions: DataFrame, entrypoints: DataFrame | None = None, base_url: str = "", prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(spec functions, verified functions): specs that a verified function leads to and all axioms, with cross-references."""
    own = catalog(functions).withColumns({"full_path": F.concat(F.lit(f"{prefix}/" if prefix else ""), "file"), "math_interpretation": math_interpretation(F.col("doc_comment")), "is_public": F.startswith("visibility", F.lit("pub"))})
    own = own.withColumns({"id": paths.entry_id(F.col("module_path"), F.col("name"), F.col("display_name")), "link": F.concat(F.lit(base_url), "full_path", F.lit("#L"), F.col("lines_start").cast("string")), "short_module": paths.short_module(F.col("module_path"))})
    spec_names = own.where("mode = 'spec'").select(F.col("name").alias("spec")).distinct()
    key = ["file", "lines_start", "name"]
    listed = lambda r: r.groupBy(*key).agg(F.array_sort(F.collect_set("spec")).alias("referenced_specs"))
    none = F.array().cast("array<string>")
    refs, body = references(own, spec_names), body_references(own.where("mode = 'spec'"), spec_names)
    with_refs = lambda df, r: df.join(listed(r), key, "left").withColumn("referenced_specs", F.coalesce("referenced_specs", none))
    specs = with_refs(own.where("mode = 'spec'"), body).withColumn("category", F.lit("spec"))
    axioms = with_refs(own.where("mode = 'proof' AND startswith(name, 'axiom_')"), refs).withColumn("category", F.lit("axiom"))
    verified = with_refs(own.where("mode = 'exec' AND specified AND NOT is_external_body"), refs)
    # one row for each name stands for its references
    edges = grouping.keep_last(specs.unionByName(axioms).select("name", "category", "file", "lines_start", "referenced_specs"), ["name"], [F.col("category"), F.col("file"), F.col("lines_start")])
    edges = edges.select(F.col("name").alias("src"), F.explode("referenced_specs").alias("dst"))
    reached = closure.reachable(verified.select(F.explode("referenced_specs").alias("id")), edges)
    kept = specs.join(reached.withColumnRenamed("id", "name"), "name", "left_semi").unionByName(axioms)
    kind = F.when(F.col("category") == "axiom", "proof fn").otherwise(F.concat(F.when(F.col("is_public"), "pub ").otherwise(""), F.col("kind")))
    spec_rows = kept.select("id", "name", F.coalesce("signature_text", F.lit("")).alias("signature"), F.coalesce("body_text", F.lit("")).alias("body"), F.col("full_path").alias("file"), F.col("lines_start").alias("line"), F.col("module_path").alias("module"), "short_module", kind.alias("visibility"), F.coalesce("doc_comment", F.lit("")).alias("doc_comment"), "math_interpretation", F.col("link").alias("github_link"), "category", "referenced_specs")
    focus = (entrypoints if entrypoints is not None else functions.sparkSession.createDataFrame([], "name string, path string")).select("name", F.col("path").alias("full_path"), F.lit(True).alias("focus")).distinct()
    done = verified.join(focus, ["name", "full_path"], "left")
    rows = done.select("id", "name", "display_name", F.coalesce("impl_type", F.lit("")).alias("impl_type"), F.concat_ws("\n", "signature_text", "requires_text", "ensures_text").alias("contract"), clause_lines(F.col("requires_text")).alias("requires"), clause_lines(F.col("ensures_text")).alias("ensures"), "referenced_specs", F.col("full_path").alias("file"), F.col("lines_start").alias("line"), F.col("short_module").alias("module"), paths.sub_module(F.col("module_path")).alias("sub_module"), F.coalesce("doc_comment", F.lit("")).alias("doc_comment"), "math_interpretation", F.col("link").alias("github_link"), F.lit("tracked").alias("category"), "is_public", F.coalesce("focus", F.lit(False)).alias("is_focus"), (F.col("has_requires") | F.col("has_ensures")).alias("has_spec"), is_proved().alias("has_proof"))
    return spec_rows.orderBy("id"), rows.orderBy("id")


def browser_counts(functions: DataFrame, spec_rows: DataFrame, verified_rows: DataFrame) -> DataFrame:
    """One row of counts: specs and axioms before pruning, those kept, verified functions, and entry points among them."""
    before = catalog(functions).agg(F.count_if((F.col("mode") == "spec") | ((F.col("mode") == "proof") & F.startswith("name", F.lit("axiom_")))).alias("before"))
    kept = spec_rows.agg(F.count_if(F.col("category") == "spec").alias("specs"), F.count_if(F.col("category") == "axiom").alias("axioms"))
    return before.crossJoin(kept).crossJoin(verified_rows.agg(F.count("*").alias("verified"), F.count_if("is_focus").alias("entry_points")))


def tracked(functions: DataFrame, base_url: str = "", prefix: str = "") -> DataFrame:
    """(function, module, link, has_spec, has_proof) of specified executable functions, those of one name as they stand in
    their files; what isn't so is left empty."""
    own = catalog(functions).where("mode = 'exec' AND specified AND NOT is_external_body")
    link = F.concat(F.lit(base_url), F.lit(f"{prefix}/" if prefix else ""), "file", F.lit("#L"), F.col("lines_start").cast("string"))
    yes = lambda c: F.when(c, "yes").otherwise("")
    rows = own.select(F.col("display_name").alias("function"), F.col("module_path").alias("module"), link.alias("link"), yes(F.col("has_requires") | F.col("has_ensures")).alias("has_spec"), yes(is_proved()).alias("has_proof"), "file", "lines_start")
    return rows.orderBy("function", F.split("file", "/"), "lines_start").drop("file", "lines_start")


def completion(rows: DataFrame) -> DataFrame:
    done = F.count_if(F.col("has_proof") == "yes")
    return rows.agg(F.count("*").alias("total"), done.alias("proved"), text.percent(done, F.count("*")).alias("percent"))


def explained(functions: DataFrame, rule_rows: DataFrame, stop_words: list[str], key: str = "code_name") -> DataFrame:
    """(key, pos, label, matched, failed): for functions that some rule matches or that have a specification, each rule
    with the criteria that failed."""
    judged = rules.without_stop_words(functions, stop_words)
    told = rules.explain(judged, rule_rows, [key])
    by_rule = told.groupBy(key, "pos", "label").agg(F.bool_and("passed").alias("matched"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("criterion")))).alias("failed"))
    wanted = by_rule.where("matched").select(key).union(functions.where("specified").select(key)).distinct()
    return by_rule.join(wanted, key, "left_semi")


def match_tracked(tracked_rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """Tracked rows (function, module) with the code_name of their atom, null if there is none: one of that name in a module
    of that name, else one of that name whose code name holds the module's (the least of several)."""
    rows = tracked_rows.select("function", "module", F.regexp_replace(F.substring_index("function", "(", 1), "^.*::", "").alias("method"), F.substring_index("module", "::", -1).alias("last"))
    own = atoms.select(F.regexp_replace("display_name", "^.*::", "").alias("method"), "code_name", F.substring_index("code_module", "/", -1).alias("in_module"))
    exact = F.col("in_module") == F.col("last")
    met = rows.join(own, "method").where(exact | F.contains("code_name", F.col("last")))
    best = met.groupBy("function", "module").agg(F.min(F.struct((~exact).alias("loose"), "code_name")).alias("b")).select("function", "module", F.col("b.code_name").alias("code_name"))
    return tracked_rows.join(best, ["function", "module"], "left")
