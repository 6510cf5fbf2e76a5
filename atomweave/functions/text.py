"""Line and clause helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading and trailing Unicode white space.
_EDGES = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def lines(c: Column) -> Column:
    """Lines of a text; one last empty line doesn't count."""
    return F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")


def clauses(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def first_line(c: Column, wanted: Callable[[Column], Column]) -> Column:
    """The first trimmed line for which ``wanted`` holds, or null."""
    return F.get(F.filter(F.transform(lines(c), strip), wanted), F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(100 * part / F.greatest(whole, F.lit(1))).cast("long"))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(c, "\x1b\\[[0-9;]*m", "")


def lines_of(text: str) -> list[str]:
    """The lines of a text, which end at a line feed (and a carriage return before it), at nothing else."""
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    return [x.removesuffix("\r") for x in lines]
