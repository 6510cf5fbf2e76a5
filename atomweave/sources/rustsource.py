"""Functions of Rust sources with verifier clauses, found from tokens: one row for each function of each file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions.text import lines_of

_TOKEN = re.compile(
    r"""(?P<doc>///(?!/)[^\n]*|/\*\*(?![*/]).*?\*/)|(?P<skip>//[^\n]*|\s+)|(?P<nest>/\*)|(?P<text>b?r(?P<hash>\#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\[^\n]+?|[^\\'\n])')
    |(?P<life>'\w+)|(?P<word>r\#\w+|[^\W\d]\w*)|(?P<number>\d[\w.]*?(?=\.\.|[^\w.]|\Z))|(?P<sign>==>|<==>|&&&|\|\|\||::|->|=>|==|!=|<=|>=|&&|\|\||\.\.=?|.)""",
    re.S | re.X,
)
#: Words that may stand before ``fn``, that open a clause, and that no call begins with.
MODIFIERS = frozenset("pub default open closed uninterp broadcast async unsafe extern const spec proof axiom exec tracked ghost checked crate super self in".split())
CLAUSES = frozenset("requires ensures decreases recommends returns opens_invariants no_unwind default_ensures via when invariant".split())
KEYWORDS = frozenset("if match while for in return let else loop move as ref mut fn forall exists choose where matches is".split())
#: The macros whose bodies hold items.
ITEM_MACROS = frozenset(["verus", "cfg_if"])
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_GOES_ON = frozenset(", && || &&& ||| == != ==> <==> ) . else < > + - * / <= >= ]".split())

COLUMNS = """name string, file string, lines_start long, lines_end long, mode string, kind string, visibility string, context string, specified boolean, has_requires boolean, has_ensures boolean,
    has_decreases boolean, has_trusted_assumption boolean, is_external_body boolean, has_no_decreases_attr boolean, requires_text string, ensures_text string, ensures_calls array<string>, requires_calls array<string>,
    ensures_calls_full array<string>, requires_calls_full array<string>, ensures_fn_calls array<string>, ensures_method_calls array<string>, requires_fn_calls array<string>, requires_method_calls array<string>,
    display_name string, impl_type string, doc_comment string, signature_text string, body_text string, req_start long, req_end long, ens_start long, ens_end long, parse_error string"""
_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in COLUMNS.split(","))])


class Source:
    """Tokens of a file with their lines and matching brackets."""

    def __init__(self, text: str):
        self.kind, self.word, self.line, self.last = [], [], [], []
        self.lines = lines_of(text)
        at, line = 0, 1
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind, value = m.lastgroup if m.lastgroup != "hash" else "text", m[0]
            if m["nest"]:
                depth, end = 1, at + 2
                while depth and (n := re.compile(r"/\*|\*/").search(text, end)):
                    depth += 1 if n[0] == "/*" else -1
                    end = n.end()
                value, kind = text[at : end if not depth else len(text)], "skip"
            if kind != "skip":
                self.kind.append(kind)
                self.word.append(value)
                self.line.append(line)
                self.last.append(line + value.count("\n"))
            line += value.count("\n")
            at += len(value)
        self.match: dict[int, int] = {}
        stack = []
        for i, w in enumerate(self.word):
            if self.kind[i] == "sign" and w in _OPEN:
                stack.append(i)
            elif self.kind[i] == "sign" and w in _CLOSE:
                if not stack or _OPEN[self.word[stack[-1]]] != w:
                    raise ValueError(f"line {self.line[i]}: unexpected {w}")
                self.match[stack.pop()] = i
        if stack:
            raise ValueError(f"line {self.line[stack[-1]]}: {self.word[stack[-1]]} is never closed")
        self.opened = {b: a for a, b in self.match.items()}

    def at(self, i: int) -> str:
        return self.word[i] if 0 <= i < len(self.word) and self.kind[i] not in ("text", "doc") else ""

    def span(self, first: int, last: int) -> str:
        return "\n".join(self.lines[first - 1 : last]).strip()

    def angle_end(self, i: int) -> int:
        """The place after the > that closes the < at i."""
        depth = 0
        while i < len(self.word):
            w = self.at(i)
            depth += {"<": 1, ">": -1}.get(w, 0)
            i = self.match.get(i, i) + 1
            if depth <= 0:
                break
        return i

    def render(self, first: int, end: int) -> str:
        out = ""
        for i in range(first, end):
            w = self.word[i]
            out += (" " if out and (out[-1] == "," or out[-1].isalnum() and (w[0].isalnum() or w[0] in "_")) else "") + w
        return out

    # ---- calls in clauses

    def calls(self, i: int, end: int) -> list[tuple[str, str | None, bool]]:
        """(name, path, is a method) of calls, outer ones first and a method before what it is called on."""
        out: list[tuple[str, str | None, bool]] = []
        while i < end:
            own: list[tuple[str, str | None, bool]] = []
            if self.kind[i] == "word" and self.word[i] not in KEYWORDS:
                path = [self.word[i]]
                i += 1
                while i < end and self.at(i) == "::":
                    if self.at(i + 1) == "<":
                        i = self.angle_end(i + 1)
                    else:
                        path.append(self.word[i + 1])
                        i += 2
                if self.at(i) == "!" and self.at(i + 1) in _OPEN:
                    i = self.match[i + 1] + 1
                elif self.at(i) == "(" and self.at(self.match[i] + 1) == "=>":
                    i = self.match[i] + 1  # a pattern
                elif self.at(i) == "(":
                    own = [(path[-1], "::".join(path) if len(path) > 1 else None, False), *self.calls(i + 1, self.match[i])]
                    i = self.match[i] + 1
            elif self.at(i) in _OPEN:
                own = self.calls(i + 1, self.match[i])
                i = self.match[i] + 1
            else:
                i += 1
                continue
            while i < end:
                if self.at(i) == "." and i + 1 < end and self.kind[i + 1] in ("word", "number"):
                    method, j = self.word[i + 1], i + 2
                    if self.at(j) == "::" and self.at(j + 1) == "<":
                        j = self.angle_end(j + 1)
                    if self.at(j) == "(":
                        own = [(method, None, True), *own, *self.calls(j + 1, self.match[j])]
                        j = self.match[j] + 1
                    i = j
                elif self.at(i) in ("[", "("):
                    own += self.calls(i + 1, self.match[i])
                    i = self.match[i] + 1
                elif self.at(i) in ("?", "@"):
                    i += 1
                else:
                    break
            out += own
        return out

    # ---- functions

    def begin(self, i: int) -> int:
        """The first token of the item whose ``fn`` is at i: its attributes, comments, visibility and modifiers."""
        while i > 0:
            if self.kind[i - 1] == "doc" or self.kind[i - 1] == "word" and self.word[i - 1] in MODIFIERS or self.kind[i - 1] == "text" and self.at(i - 2) == "extern":
                i -= 1
            elif self.at(i - 1) == ")" and self.at(self.opened[i - 1] - 1) in ("pub", "spec"):
                i = self.opened[i - 1]
            elif self.at(i - 1) == "]" and self.at(self.opened[i - 1] - 1) == "#":
                i = self.opened[i - 1] - 1
            else:
                break
        return i

    def head(self, fn: int) -> tuple[int, dict[str, tuple[int, int]]]:
        """Where the body (or ;) of the function is, and the tokens [first, end) of each clause after its keyword."""
        i = fn + 2
        if self.at(i) == "<":
            i = self.angle_end(i)
        i = self.match[i] + 1 if self.at(i) == "(" else i
        clauses: dict[str, tuple[int, int]] = {}
        name, since = "", i
        while i < len(self.word):
            w = self.at(i)
            after = self.at(self.match[i] + 1) if i in self.match else ""
            body = w == ";" or w == "{" and not (name and self.at(i - 1) not in (",", name) and (after in _GOES_ON or after in CLAUSES))
            if body or w in CLAUSES or w == "}":
                if name:
                    clauses.setdefault(name, (since, i))
                if body or w == "}":
                    return i, clauses
                name, since = w, i + 1
            i = self.match.get(i, i) + 1
        return len(self.word) - 1, clauses

    def functions(self, methods: bool = True) -> Iterator[dict]:
        scopes: list[tuple[int, str, str | None]] = []  # end, context, type
        waiting: tuple[str, str | None] | None = None
        after = 0  # what other macros hold are tokens, not items
        for i, w in enumerate(self.word):
            if i < after:
                continue
            after = self.macro_end(i)
            while scopes and i >= scopes[-1][0]:
                scopes.pop()
            if self.kind[i] == "sign" and w == "{" and waiting:
                scopes.append((self.match[i], *waiting))
                waiting = None
            elif self.kind[i] == "sign" and w == ";":
                waiting = None
            if self.kind[i] != "word":
                continue
            if w == "impl" and self.at(i - 1) not in ("->", ":", "(", ",", "&", "<", "=", "mut", "+"):
                waiting = ("impl", self.impl_type(i))
            elif w == "trait" and i + 1 < len(self.word) and self.kind[i + 1] == "word":
                waiting = ("trait", None)
            elif w == "fn" and i + 1 < len(self.word) and self.kind[i + 1] == "word":
                end, clauses = self.head(i)
                context, own = (scopes[-1][1], scopes[-1][2]) if scopes else ("standalone", None)
                if not methods and any(c in ("impl", "trait", "method") for _, c, _ in scopes):
                    context = "dropped"
                if context != "dropped":
                    yield self.row(i, end, clauses, "standalone" if context == "method" else context, own)
                if end in self.match:
                    scopes.append((self.match[end], "method" if context in ("impl", "trait", "method", "dropped") else "standalone", own))
                waiting = None

    def macro_end(self, i: int) -> int:
        """Where the body of the macro called at ``i`` ends, if that isn't one of items; else 0."""
        if self.kind[i] != "word" or self.at(i + 1) != "!" or self.word[i] in KEYWORDS or self.word[i] in ITEM_MACROS and self.at(i - 1) != "::":
            return 0
        body = i + 3 if self.word[i] == "macro_rules" else i + 2
        return self.match.get(body, 0) if self.at(body) in _OPEN else 0

    def impl_type(self, i: int) -> str:
        j = i + 1
        if self.at(j) == "<":
            j = self.angle_end(j)
        first = j
        while j < len(self.word) and self.at(j) not in ("{", "where", ";"):
            if self.at(j) == "for" and self.at(j + 1) != "<":
                first = j + 1
            j = self.angle_end(j) if self.at(j) == "<" else self.match.get(j, j) + 1
        return self.render(first, j).lstrip("&")

    def row(self, fn: int, end: int, clauses: dict[str, tuple[int, int]], context: str, own: str | None) -> dict:
        first = self.begin(fn)
        start, stop = self.line[first], self.last[self.match.get(end, end)]
        before = [self.at(k) for k in range(first, fn)]
        modes = {"spec": "spec(checked)" if "checked" in before else "spec", "proof": "proof", "axiom": "proof(axiom)", "exec": "exec"}
        said = next((modes[x] for x in before if x in modes), "")
        mode = "spec" if said.startswith("spec") else "proof" if said.startswith("proof") else "exec"
        seen = "private"
        if "pub" in before:
            p = first + before.index("pub")
            inner = self.render(p + 2, self.match[p + 1]) if self.at(p + 1) == "(" else None
            seen = "pub" if inner is None else f"pub({inner})" if inner in ("crate", "self", "super") else "pub(restricted)"
        if context == "trait":
            seen = "private"
        attrs = {self.word[k + 2] for k in range(first, fn - 2) if self.word[k] == "verifier" and self.word[k + 1] == "::"}
        found = {c: self.calls(*clauses[c]) if c in clauses else [] for c in ("requires", "ensures")}
        lines = {c: (self.line[clauses[c][0] - 1], self.last[self._last(clauses[c])]) if c in clauses else None for c in ("requires", "ensures")}
        raw = [x.strip() for x in self.lines[start - 1 : stop]]
        name = self.word[fn + 1]
        out = {
            "name": name, "lines_start": start, "lines_end": stop, "mode": mode, "kind": " ".join(x for x in (said, "const" if "const" in before else "", "fn") if x), "visibility": seen, "context": context,
            "specified": "requires" in clauses or "ensures" in clauses, "has_decreases": "decreases" in clauses, "has_trusted_assumption": any("assume(" in x or "admit(" in x for x in raw),
            "is_external_body": "external_body" in attrs, "has_no_decreases_attr": "exec_allows_no_decreases_clause" in attrs, "impl_type": own, "display_name": f"{own}::{name}" if own else name,
            "doc_comment": _doc(raw), "signature_text": _signature(self.lines[start - 1 : stop]), "body_text": self.span(start, stop) if mode == "spec" else None,
        }
        for c, short in (("requires", "req"), ("ensures", "ens")):
            out |= {
                f"has_{c}": c in clauses, f"{c}_text": self.span(*lines[c]) if lines[c] else None, f"{short}_start": lines[c][0] if lines[c] else None, f"{short}_end": lines[c][1] if lines[c] else None,
                f"{c}_calls": [n for n, _, _ in found[c]], f"{c}_calls_full": [p or n for n, p, _ in found[c]], f"{c}_fn_calls": [n for n, _, m in found[c] if not m], f"{c}_method_calls": [n for n, _, m in found[c] if m],
            }
        return out

    def _last(self, clause: tuple[int, int]) -> int:
        """The last token of a clause's last expression; a comma after it isn't part of it."""
        last = max(clause[1] - 1, clause[0] - 1)
        return last - 1 if self.at(last) == "," and last > clause[0] else last


def _doc(lines: list[str]) -> str | None:
    n = next((i for i, x in enumerate(lines) if not x.startswith("///")), len(lines))
    return "\n".join(x[3:].removeprefix(" ") for x in lines[:n]) or None if n else None


def _signature(lines: list[str]) -> str | None:
    """The lines after comments and attributes up to the first brace."""
    rest = lines[next((i for i, x in enumerate(lines) if not x.strip().startswith(("///", "#["))), len(lines)) :]
    n = next((i for i, x in enumerate(rest) if "{" in x), None)
    kept = [x.strip() for x in (rest if n is None else rest[:n])]
    if n is not None and (before := rest[n].split("{")[0].rstrip()):
        kept.append(before)
    return "\n".join(kept) or None


def read_sources(spark: SparkSession, path: str, pattern: str = "*.rs") -> DataFrame:
    """(file, content) of all sources under ``path``, files relative to it."""
    base = path.rstrip("/")
    whole = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return whole.select(F.regexp_replace(name, f"^.*{re.escape(base)}/", "").alias("file"), F.col("value").alias("content"))


def functions(sources: DataFrame, methods: bool = True) -> DataFrame:
    """The function catalog of (file, content); a file that can't be read gives one row with parse_error and no name."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = [r | {"file": file} for r in Source(content or "").functions(methods)]
                except (ValueError, KeyError, IndexError) as e:
                    found = [{"file": file, "parse_error": str(e)}]
                rows += found
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return sources.select("file", "content").mapInArrow(run, COLUMNS)


def spans(catalog: DataFrame) -> DataFrame:
    """(path, name, start, end, mode and clause ranges), the span table that a call graph is joined to."""
    return catalog.where(F.col("name").isNotNull()).select(F.col("file").alias("path"), "name", F.col("lines_start").alias("start"), F.col("lines_end").alias("end"), "mode", "req_start", "req_end", "ens_start", "ens_end")
