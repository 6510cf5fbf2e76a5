"""Verifier logs: error locations, failures, compiler messages, and what they say about functions.

Logs are rows (log_id, text); any number of them is worked on at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.functions import paths
from atomweave.functions.text import strip, without_ansi
from atomweave.operators import grouping, joins, scan
from atomweave.operators.cut import cut

LOCATION = r"-->\s+([^:]+):(\d+):(\d+)"
#: The failures that a verifier reports, in order of precedence.
FAILURES = ("assertion failed", "postcondition not satisfied", "precondition not satisfied", "loop invariant not preserved", "loop invariant not satisfied on entry", "assertion not satisfied")
RESULTS = r"verification results::\s*(\d+)\s+verified,\s*(\d+)\s+errors?"
LOOKBACK, CONTEXT, DETAILS = 10, 15, 10
#: Lines of a piece of a log that one task looks at.
PIECE = 100_000


def _one(*parts: str) -> Column:
    """A condition on the trimmed line: it holds one of the texts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(strip(F.col("line")), F.lit(p))
    return out


def log_lines(logs: DataFrame) -> DataFrame:
    return grouping.lines(logs, ["log_id"], "text")


def locations(lines: DataFrame) -> DataFrame:
    """(log_id, pos, file, line_number): places that stand under an error, not under a note on time spent."""
    bare = strip(F.col("line"))
    timing = _one("has been running for", "finished in")
    error = (F.startswith(bare, F.lit("error:")) | F.startswith(bare, F.lit("error["))) & ~timing
    flag = F.when(error, True).when(F.startswith(bare, F.lit("note:")) & timing, False)
    marked = grouping.flagged_before(lines, ["log_id"], ["pos"], flag, LOOKBACK, "actual", PIECE)
    return marked.where(F.col("actual") & F.col("line").rlike(LOCATION)).select("log_id", "pos", F.regexp_extract("line", LOCATION, 1).alias("file"), F.coalesce(F.regexp_extract("line", LOCATION, 2).try_cast("int"), F.lit(0)).alias("line_number"))


def failures(lines: DataFrame) -> DataFrame:
    """(log_id, pos, error_type, file, line_number, column, message, assertion_details, full_error_text)."""
    kind = F.coalesce(*[F.when(F.contains(F.col("line"), F.lit(f)), f) for f in FAILURES])
    own = lines.withColumn("error_type", kind).where(F.col("error_type").isNotNull() & F.contains(F.lower("line"), F.lit("error")))
    # only these lines ask for what follows them, by position
    asked = own.select("log_id", F.col("pos").alias("at"), F.explode(F.sequence(F.col("pos"), F.col("pos") + CONTEXT)).alias("pos"))
    ahead = asked.join(lines.select("log_id", "pos", "line"), ["log_id", "pos"]).groupBy("log_id", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("ahead"))
    own = own.join(ahead.withColumnRenamed("at", "pos"), ["log_id", "pos"])
    places = F.filter(F.transform(F.slice("ahead", 1, CONTEXT), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike(LOCATION))
    own = own.withColumn("place", F.get(places, F.lit(0)))
    after = lambda i: strip(F.get("ahead", i + 1))
    # the context ends at a blank line before something new, once it is two lines or more past the place
    ends = F.filter(
        F.sequence(F.lit(0), F.size("ahead") - 1),
        lambda i: (i > F.col("place.i") + 1) & (strip(F.get("ahead", i)) == "") & F.coalesce(F.startswith(after(i), F.lit("error:")) | F.startswith(after(i), F.lit("verification results")) | F.startswith(after(i), F.lit("note:")), F.lit(False)),
    )
    size = F.least(F.coalesce(F.get(ends, F.lit(0)) + 1, F.lit(CONTEXT)), F.lit(CONTEXT), F.size("ahead"))
    own = own.withColumn("clean", F.transform(F.slice("ahead", F.lit(1), size), lambda x: without_ansi(F.regexp_replace(x, r"(?U)\s+$", ""))))
    told = lambda x: (strip(x) != "") & (F.contains(x, F.lit("assert")) | F.contains(x, F.lit("|")) | F.startswith(strip(x), F.lit("-->")))
    x = F.col("place.x")
    return own.select(
        "log_id", "pos", "error_type", without_ansi(F.regexp_extract(x, LOCATION, 1)).alias("file"),
        F.when(x.isNotNull(), F.coalesce(F.regexp_extract(x, LOCATION, 2).try_cast("int"), F.lit(0))).alias("line_number"),
        F.regexp_extract(x, r":([+-]?\d+)$", 1).try_cast("int").alias("column"), without_ansi(strip(F.col("line"))).alias("message"),
        F.slice(F.filter("clean", told), 1, DETAILS).alias("assertion_details"), strip(F.array_join("clean", "\n")).alias("full_error_text"),
    )


# ---- compiler messages ------------------------------------------------------------------------------------------

#: What a line is: the first of these that fits.  Fixed values: the forms are the compiler's and the verifier's.
_KINDS = [
    ("results", RESULTS),
    ("crate", r"error: could not compile `([^`]+)`"),
    ("memory", r"memory allocation of \d+ bytes failed"),
    ("exit", r"Verus command completed with exit code: (\d+)"),
    ("process", r"(?s)process didn't exit successfully: (.+)"),
    ("failure", "|".join(f"error: {f}" for f in FAILURES)),
    ("error", r"(?s)error(?:\[E\d+\])?: (.+)"),
    ("warning", r"(?s)warning: (.+)"),
    ("place", LOCATION),
    ("more", r"^[|^=]|^Caused by:|^\(signal:|\(exit status: \d+\)"),
    ("blank", r"^$"),
]
_STATUS = r"\(exit status: (\d+)\)"


def _states(lines: DataFrame) -> DataFrame:
    """Lines (log_id, pos, line, kind, level, id) that belong to a message, and blank ones: which message each is part of.

    What is open is a state that each line maps to another: it opens an error or a warning, closes both, or leaves all as it
    is.  Such maps compose to the last one that isn't the identity, so pieces of a log are scanned apart and a short table
    of their last maps tells where each begins."""
    bare = strip(F.col("line"))
    kind = F.coalesce(*[F.when(bare.rlike(p), k) for k, p in _KINDS])
    # what is looked at again and again is written once
    told = cut(lines.select("log_id", "pos", bare.alias("line"), kind.alias("kind")).where("kind IS NOT NULL"))
    # in a log with results, crates that didn't compile count for nothing
    done = told.where("kind = 'results'").select("log_id").distinct()
    crates = told.where("kind = 'crate'").join(done, "log_id", "left_anti")
    told = told.where("kind NOT IN ('results', 'failure', 'crate')").unionByName(crates)
    pieces = scan.blocked_by_position(told, "pos", PIECE)
    opens = F.when(F.col("kind").isin("error", "crate", "exit", "process"), True).when(F.col("kind") == "blank", False)
    pieces = scan.carried(pieces, ["log_id"], ["pos"], opens, "open", before=True)
    begins = F.col("kind").isin("error", "crate") | (F.col("kind").isin("exit", "process") & ~F.coalesce("open", F.lit(False)))
    error, warning = F.when(begins, F.col("pos")).when(F.col("kind") == "blank", 0), F.when(F.col("kind") == "warning", F.col("pos")).when(F.col("kind") == "blank", 0)
    pieces = scan.carried_all(pieces, ["log_id"], ["pos"], {"error_before": error, "warning_before": warning}, before=True)
    pieces = pieces.withColumns({"error_now": F.coalesce(error, "error_before", F.lit(0)), "warning_now": F.coalesce(warning, "warning_before", F.lit(0))})
    alone = (F.col("kind") == "memory") & (F.col("error_now") == 0)
    part = F.when(begins, "error").when(F.col("kind") == "warning", "warning").when(alone, "alone").when(F.col("kind") == "blank", None).when(F.col("error_now") > 0, "error").when(F.col("kind").isin("place", "more") & (F.col("warning_now") > 0), "warning")
    ids = F.when(part == "error", F.col("error_now")).when(part == "warning", F.col("warning_now")).when(part == "alone", F.col("pos"))
    closed = F.array_compact(F.array(
        F.when((begins | (F.col("kind") == "blank")) & (F.col("error_before") > 0), F.struct(F.lit("error").alias("level"), F.col("error_before").alias("id"), F.lit(0).alias("turn"))),
        F.when(F.col("kind").isin("warning", "blank") & (F.col("warning_before") > 0), F.struct(F.lit("warning").alias("level"), F.col("warning_before").alias("id"), F.lit(1).alias("turn"))),
        F.when(alone, F.struct(F.lit("alone").alias("level"), F.col("pos").alias("id"), F.lit(0).alias("turn"))),
    ))
    return pieces.select("log_id", "pos", "line", "kind", part.alias("level"), ids.alias("id"), closed.alias("closed")).where(F.col("level").isNotNull() | (F.size("closed") > 0))


def messages(lines: DataFrame) -> DataFrame:
    """(log_id, seq, level, message, file, line_number, column, full_message) of compiler errors and warnings in the order in
    which they close.  At most one of each is open; a place or a continuation goes to the error if there is one, a blank
    line closes both.  ``lines``: (log_id, pos, line); a log may be of any length."""
    rows = cut(_states(lines))
    line, pattern = F.col("line"), dict(_KINDS)
    first = F.col("pos") == F.col("id")
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0)).cast("long")
    said = {"crate": F.concat(F.lit("Compilation failed for crate: "), F.regexp_extract(line, pattern["crate"], 1)), "exit": F.concat(F.lit("Verus command failed with exit code "), F.regexp_extract(line, pattern["exit"], 1)), "process": F.concat(F.lit("Process execution failed: "), F.regexp_extract(line, pattern["process"], 1)), "memory": line}
    said |= {k: strip(F.regexp_extract(line, pattern[k], 1)) for k in ("error", "warning")}
    adds = {"memory": F.concat(F.lit(" - "), line), "exit": F.concat(F.lit(" (exit code: "), F.regexp_extract(line, pattern["exit"], 1), F.lit(")")), "process": F.concat(F.lit(" - "), F.regexp_extract(line, pattern["process"], 1))}
    cause = F.when(F.startswith(line, F.lit("Caused by:")) | F.contains(line, F.lit("(signal:")), F.concat(F.lit(" - "), line)).otherwise("")
    status = F.when(line.rlike(_STATUS), F.concat(F.lit(" (exit status: "), F.regexp_extract(line, _STATUS, 1), F.lit(")"))).otherwise("")
    more = F.when((F.col("kind") == "more") & (F.col("level") == "error"), F.concat(cause, status)).otherwise("")
    text = F.when(first, F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in said.items()])).otherwise(F.coalesce(*[F.when(F.col("kind") == k, x) for k, x in adds.items()], more))
    place = F.when(F.col("kind") == "place", F.struct(F.regexp_extract(line, LOCATION, 1).alias("file"), number(F.regexp_extract(line, LOCATION, 2)).alias("line_number"), number(F.regexp_extract(line, LOCATION, 3)).alias("column")))
    parts = rows.where("level IS NOT NULL").select("log_id", "level", "id", "pos", "line", text.alias("text"), place.alias("place"))
    found = parts.groupBy("log_id", "level", "id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "text"))).alias("parts"), F.max_by("place", F.when(F.col("place").isNotNull(), F.col("pos"))).alias("place"))
    closed = rows.select("log_id", F.col("pos").alias("end"), F.inline("closed"))
    # messages that nothing closes come last, as they began
    found = found.join(closed, ["log_id", "level", "id"], "left").withColumns({"end": F.coalesce("end", F.lit(2**62)), "turn": F.coalesce(F.col("turn").cast("long"), F.col("id"))})
    listed = scan.numbered(cut(found).withColumn("__block", F.floor(F.col("end") / PIECE)), ["log_id"], ["end", "turn"], "seq")
    level = F.when(F.col("level") == "warning", "warning").otherwise("error")
    return listed.select("log_id", (F.col("seq") - 1).alias("seq"), level.alias("level"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("message"), F.col("place.file").alias("file"), F.col("place.line_number").alias("line_number"), F.col("place.column").alias("column"), F.transform("parts", lambda p: p["line"]).alias("full_message"))


# ---- analysis ---------------------------------------------------------------------------------------------------


def failed_functions(functions: DataFrame, places: DataFrame) -> DataFrame:
    """(log_id, name, file, lines_start) of the innermost function around each place (log_id, file, line_number); a file
    is the one whose path matches best."""
    asked = places.select("log_id", "file", F.col("file").alias("said")).distinct()
    files = functions.select("log_id", F.col("file").alias("own")).distinct()
    best = paths.best_match(asked, files, "file", "said", "own", ["log_id"]).select("log_id", "file", "own")
    points = places.select("log_id", "file", "line_number").distinct().join(best, ["log_id", "file"]).select("log_id", F.col("own").alias("file"), F.col("line_number").cast("long").alias("line_number")).distinct()
    return joins.innermost(points, functions.select("log_id", "file", "name", "lines_start", "lines_end"), ["log_id", "file"], "line_number", "lines_start", "lines_end").select("log_id", "name", "file", "lines_start").distinct()


def analyze(logs: DataFrame, functions: DataFrame, module: str | None = None, function: str | None = None, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(functions with category failed, unverified or verified; a summary row for each log with status and counts).

    logs: (log_id, text, exit_code), or (log_id, exit_code) with their ``lines`` (log_id, pos, line) beside them; functions:
    (log_id, name, file, lines_start, lines_end, has_requires, has_ensures, has_trusted_assumption)."""
    lines = log_lines(logs) if lines is None else lines
    failed = cut(failures(lines))  # this and the places are asked for many times, the lines behind them once
    places = locations(lines).select("log_id", "file", "line_number").union(failed.where("file IS NOT NULL AND line_number IS NOT NULL").select("log_id", "file", "line_number"))
    places = cut(places.distinct())
    told = messages(lines).groupBy("log_id").agg(F.count_if(F.col("level") == "error").alias("compilation_errors"), F.count_if(F.col("level") == "warning").alias("compilation_warnings"))
    done = lines.where(F.col("line").rlike(RESULTS)).select("log_id", F.lit(True).alias("finished")).distinct()
    state = logs.select("log_id", "exit_code").join(done, "log_id", "left").fillna(False, ["finished"]).join(told, "log_id", "left").join(failed.groupBy("log_id").agg(F.count("*").alias("verification_errors")), "log_id", "left").fillna(0, ["compilation_errors", "compilation_warnings", "verification_errors"])
    lost = F.coalesce(F.col("exit_code") != 0, F.lit(False)) & (F.col("verification_errors") == 0)
    status = F.when(F.col("finished"), F.when(F.col("verification_errors") > 0, "verification_failed").otherwise("success")).when((F.col("compilation_errors") > 0) | lost, "compilation_failed").otherwise("success")
    state = state.withColumn("status", status)
    checked = functions.where(F.col("has_requires") | F.col("has_ensures"))
    marks = failed_functions(checked, places).withColumn("hit", F.lit(True))
    own = checked.join(marks, ["log_id", "name", "file", "lines_start"], "left").join(state.where("status <> 'compilation_failed'").select("log_id"), "log_id", "left_semi")
    own = own.withColumn("category", F.when(F.col("hit"), "failed").when(F.col("has_trusted_assumption"), "unverified").otherwise("verified")).drop("hit")
    if module:
        inside = module.replace("::", "/")
        own = own.where(F.contains("file", F.lit(f"/{inside}.rs")) | F.contains("file", F.lit(f"/{inside}/")))
    if function:
        own = own.where(F.col("name") == function)
    counts = own.groupBy("log_id").agg(F.count("*").alias("total_functions"), *[F.count_if(F.col("category") == c).alias(f"{c}_functions") for c in ("failed", "verified", "unverified")])
    names = ["total_functions", "failed_functions", "verified_functions", "unverified_functions"]
    summary = state.join(counts, "log_id", "left").fillna(0, names).select("log_id", "status", *names, "verification_errors", "compilation_errors", "compilation_warnings")
    return own, summary


def proofs(results: DataFrame, atoms: DataFrame, tolerance: int = 5) -> DataFrame:
    """(code_name, code_path, code_line, verified, status) of categorised functions: each takes the nearest atom of its
    name and path; of several results for one atom an unverified one counts before a failed one before a verified one."""
    found = match_atoms(results, atoms, tolerance, use_span=False)
    status = F.when(F.col("category") == "failed", "failure").when(F.col("category") == "unverified", "sorries").otherwise("success")
    rank = F.when(F.col("category") == "unverified", 2).when(F.col("category") == "failed", 1).otherwise(0)
    rows = found.select("code_name", F.col("file").alias("code_path"), F.col("lines_start").alias("code_line"), (F.col("category") == "verified").alias("verified"), status.alias("status"), rank.alias("rank"))
    return grouping.keep_last(rows, ["code_name"], [F.col("rank"), F.col("code_path"), F.col("code_line")]).drop("rank")


def with_code_names(results: DataFrame, atoms: DataFrame, tolerance: int = 5) -> DataFrame:
    """``results`` with the code_name of the nearest atom of their name and path, null where none is within ``tolerance`` lines."""
    keys = ["name", "file", "lines_start", "lines_end"]
    own = results.select(*keys).where(F.col("name").isNotNull() & F.col("file").isNotNull()).distinct()
    return results.join(match_atoms(own, atoms, tolerance, use_span=False), keys, "left").select(*results.columns, "code_name")


def errors_by_file(lines: DataFrame) -> DataFrame:
    """(log_id, file, line_numbers): the places of errors in each file, in order."""
    return locations(lines).groupBy("log_id", "file").agg(F.array_sort(F.collect_list("line_number")).alias("line_numbers"))


def match_atoms(functions: DataFrame, atoms: DataFrame, tolerance: int = 5, use_span: bool = True, name_match: str = "bare") -> DataFrame:
    """``functions`` (name, file, lines_start, lines_end) with the code_name of the nearest atom of equal name whose path
    matches by suffix and whose first line lies in the function (``use_span``) or within ``tolerance`` of its start."""
    bare = F.regexp_extract("display_name", "(?s)^(?:.*::)?(.*)$", 1) if name_match == "bare" else F.col("display_name")
    keys = ["name", "file", "lines_start", "lines_end"]
    a = atoms.select(bare.alias("name"), "code_name", "code_path", F.col("lines_start").alias("atom_line"))
    # what matches are paths first, then functions and atoms of such paths and one name by the cells of their lines
    own = functions.select(*keys).distinct()
    own = own.join(paths.matching(own, a, "file", "code_path"), "file")
    best = joins.nearest_within(own, a, ["name", "code_path"], "lines_start", "atom_line", tolerance, keys, "code_name", ("lines_start", "lines_end") if use_span else None)
    return functions.join(best.select(*keys, "code_name"), keys)
