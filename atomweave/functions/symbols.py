"""Code-index symbols, signatures and the names built from them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbol prefix of the index, the prefix of code names, the role bit of a definition, the kinds of
#: functions, the look-back for type context and the tolerance of line matches, in lines.
SYMBOL_PREFIX = "rust-analyzer cargo "
CODE_PREFIX = "probe:"
DEFINITION = 1
FUNCTION_KINDS = (6, 17, 26, 80)
CONTEXT_LINES = 5
LINE_TOLERANCE = 5

_SPACE = r"(?U)^\s+|\s+$"
_LIFETIMES = r"^(?:'a )*(?:'b )*(?:'_ )*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE, "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: without it, nested uses would multiply the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_definition(roles: Column) -> Column:
    return F.coalesce(roles, F.lit(0)).bitwiseAND(DEFINITION) != 0


def is_function(kind: Column) -> Column:
    return kind.isin(*FUNCTION_KINDS)


def unique_key(symbol: Column, signature: Column, self_type: Column, line: Column) -> Column:
    """``symbol|signature[|self][@line]``."""
    return F.concat(F.concat_ws("|", symbol, signature, self_type), F.coalesce(F.concat(F.lit("@"), line.cast("string")), F.lit("")))


def display_name(symbol: Column, base: Column) -> Column:
    """``Type::base`` if the symbol's last path segment names a type, else ``base``."""
    rest = F.split(F.regexp_replace(symbol, f"^{SYMBOL_PREFIX}", ""), " ", 3)
    segment = F.regexp_extract(F.get(rest, F.lit(2)), "[^/]*$", 0)
    owner = F.regexp_replace(F.regexp_extract(segment, "^([^#]*)#", 1), "^&", "")
    return F.when((F.size(rest) == 3) & (owner != ""), F.concat(owner, F.lit("::"), base)).otherwise(base)


def type_name(symbol: Column) -> Column:
    """The name of a type symbol: what follows its last slash, without the # at its end."""
    return F.nullif(F.regexp_extract(symbol, "/([^/]+?)#*$", 1), F.lit(""))


def owned_type(c: Column) -> Column:
    """A return type without reference, lifetime and mut."""
    return _trim(F.regexp_replace(F.regexp_replace(_trim(c), "^&+", ""), _LIFETIMES + "(?:mut )*", ""))


def _referenced(bare: Column, inner: Column) -> Column:
    """``inner``, with the & of ``bare`` if it has one; null if nothing is left."""
    return _let(inner, lambda x: F.when(x != "", F.when(F.startswith(bare, F.lit("&")), F.concat(F.lit("&"), x)).otherwise(x)))


def param_type(c: Column) -> Column:
    """A parameter's type without lifetime and mut; a reference keeps its &."""
    return _let(_trim(c), lambda bare: _referenced(bare, _trim(F.regexp_replace(_trim(F.regexp_replace(bare, "^&+", "")), _LIFETIMES + "(?:mut )*", ""))))


def _after(c: Column, mark: str) -> Column:
    """What follows the first ``mark``, or null."""
    return _let(c, lambda x: F.when(F.contains(x, F.lit(mark)), F.substr(x, F.instr(x, mark) + len(mark))))


def impl_type_info(signature: Column) -> Column:
    """What tells an implementation apart: its second parameter's type, else an only one's that isn't self, else the
    return type unless that is Self."""

    def told(whole: Column) -> Column:
        listed = F.transform(F.split(F.regexp_extract(whole, r"(?s)\(([^)]*)\)", 1), ","), _trim)
        chosen = _let(listed, lambda p: F.when(F.size(p) >= 2, F.get(p, F.lit(1))).when(~F.startswith(F.get(p, F.lit(0)), F.lit("self")), F.get(p, F.lit(0))))
        returned = _let(owned_type(_after(whole, "->")), lambda r: F.when((r != "") & (r != "Self"), r))
        return F.when(whole.rlike(r"(?s)^[^()]*\([^)]*\)"), F.coalesce(param_type(_after(chosen, ":")), returned))

    return _let(_trim(signature), told)


def self_type(signature: Column) -> Column:
    """The type in ``self: T``; a reference keeps its &."""
    return _let(_trim(_after(_trim(signature), ":")), lambda part: _referenced(part, _trim(F.regexp_replace(F.regexp_replace(part, "^&+", ""), _LIFETIMES, ""))))


def lacks_self(symbol: Column) -> Column:
    return F.length(symbol) - F.length(F.replace(symbol, F.lit("#"), F.lit(""))) == 1


def code_module(code_name: Column) -> Column:
    """The path between version and type of a code name."""
    before = F.regexp_extract(F.regexp_replace(code_name, f"^{CODE_PREFIX}", ""), "^[^#]*", 0)
    parts = F.split(before, "/")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "/")).otherwise("")


def code_name(symbol: Column, display: Column, signature: Column, self_: Column, line: Column | None = None, target: Column | None = None) -> Column:
    """The code name of a function symbol, with what tells it apart from its like: the implemented trait's type argument,
    the Self type where the symbol lacks it, a target type, a line.  Symbols of another form keep their text."""
    none = F.lit(None).cast("string")
    target, line = none if target is None else target, none if line is None else line.cast("string")
    rest = F.regexp_replace(symbol, f"^{SYMBOL_PREFIX}", "")
    ending = F.concat(F.regexp_replace(display, "(?s)^.*::", ""), F.lit("()."))
    known = F.startswith(symbol, F.lit(SYMBOL_PREFIX)) & F.endswith(rest, ending)
    group = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    bare = F.regexp_replace(rest, r"\.$", "")
    # the type argument goes before the last #, the Self type after the last /, the target type before the first #
    typed = _let(F.struct(bare.alias("b"), impl_type_info(signature).alias("i")), lambda x: F.when(x["i"].isNotNull() & F.contains(x["b"], F.lit("#")), F.concat(group(x["b"], "^(.*)#[^#]*$"), F.lit("<"), x["i"], F.lit(">"), group(x["b"], "(#[^#]*)$"))).otherwise(x["b"]))
    owned = _let(typed, lambda x: F.when(self_.isNotNull() & lacks_self(x) & F.contains(x, F.lit("/")), F.concat(group(x, "^(.*/)[^/]*$"), self_, F.lit("#"), group(x, "([^/]*)$"))).otherwise(x))
    aimed = _let(owned, lambda x: F.when(target.isNotNull() & F.contains(x, F.lit("#")) & ~F.endswith(group(x, "^([^#]*)"), F.lit(">")), F.concat(group(x, "^([^#]*)"), F.lit("<"), target, F.lit(">"), group(x, "^[^#]*(#.*)$"))).otherwise(x))
    numbered = F.concat(aimed, F.coalesce(F.concat(F.lit("@"), line), F.lit("")))
    return F.concat(F.lit(CODE_PREFIX), F.translate(F.when(known, numbered).otherwise(F.replace(symbol, F.lit(SYMBOL_PREFIX), F.lit(""))), " ", "/"))


def call_location(line: Column, requires: tuple[Column, Column], ensures: tuple[Column, Column]) -> Column:
    return F.when(line.between(*requires), "precondition").when(line.between(*ensures), "postcondition").otherwise("inner")


def mode(c: Column) -> Column:
    """exec, proof or spec; anything else, null included, is exec."""
    low = F.lower(c)
    return F.when(low.isin("proof", "spec"), low).otherwise("exec")
