"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns look-alike letters and digits written for letters into plain ones and all other
characters into spaces.  The lexicon holds words and word beginnings whose documents are labelled toxic far more
often than others, weighted by their log odds.  The logistic scale of the score is learnt from rows that the terms
used for it haven't seen; the terms in use are then learnt from all labelled rows.  Phrases of a term and its neighbour that clean rows repeat and toxic rows never
hold are exceptions, as are those given; a term inside one doesn't count.  Sums are divided by text length.

Bounds: at most TRAIN_ROWS labelled rows and LEXICON_TERMS terms are used for fitting, rows chosen by hash of their key.

Defined results: null, empty and wordless texts score as a text without a term.  Rows without a label (null included)
don't teach; with no usable label at all every score is the rate 0.  Of several labels of one key the toxic one counts;
all rows of a key learn from it.  Texts of any length are matched whole, words of any length too; repeated rows are
scored each; an empty table gives an empty result.  Equal odds go to the term in more documents, then to the lesser one.
Input columns named score or predicted are replaced, others kept.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import slices, staged

#: Labelled rows used to fit, at most (all, if fewer); terms kept; documents a term needs; least log odds of a term.
TRAIN_ROWS = 24_000
LEXICON_TERMS = 4_000
LEAST_DOCS = 4
LEAST_ODDS = 3.0
#: Share of the rows, in tenths, that teach terms; the others scale the score.
TERM_TENTHS = 6
#: Letters of a word beginning.
PREFIX = range(4, 10)
#: predicted is 1 from this score on.
THRESHOLD = 0.3
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown")

#: Cyrillic and Greek letters that look like Latin ones, and signs and digits written for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """A translation that works characters out as they come and keeps them."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        out = "".join(LOOKALIKES.get(x) or DIGITS.get(x) or (x if x.isalpha() else " ") for x in plain)
        self[code] = out if plain or unicodedata.combining(c[:1]) else " "
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words, one space before, between and after them."""
    return f" {' '.join(text.translate(_FOLD).split())} "


class Lexicon:
    """Terms with weights and exception phrases in one automaton.  A term begins at a word's start: " stem" stands for
    all words that begin so, " word " for the word alone."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = ()):
        self.machine = ahocorasick.Automaton()
        spelt: dict[str, float] = {}
        for term, weight in terms.items():
            # the folding of 1 is i, which may have been written for l; of terms spelt alike the heaviest counts
            for word in (term, term.replace("l", "i")):
                spelt[word] = max(weight, spelt.get(word, weight))
        for word, weight in spelt.items():
            self.machine.add_word(word, (len(word), weight))
        for phrase in exceptions:
            self.machine.add_word(fold(phrase), (len(fold(phrase)), None))
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, folded: str) -> dict[int, float]:
        """Weight of each word that a term matches, by where the word starts; the heaviest term counts."""
        if not len(self.machine):
            return {}
        out: dict[int, float] = {}
        free = []
        for end, (length, weight) in self.machine.iter(folded):
            at = end - length + 1
            if weight is None:
                free.append((at, end))
            elif weight > out.get(at, 0):
                out[at] = weight
        for a, b in free:
            for at in [x for x in out if a <= x < b]:
                del out[at]
        return out

    def features(self, text: str | None) -> list[float]:
        folded = fold(text or "")
        found = self.hits(folded).values()
        n, total = folded.count(" ") - 1 + 8, sum(found)
        return [1.0, math.log1p(total), max(found, default=0.0), total / math.sqrt(n), 100 * len(found) / n]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; the first column isn't shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A fitted lexicon with its scale."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...], weights: np.ndarray):
        self.terms, self.exceptions, self.weights = terms, exceptions, weights

    def score(self, docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """``docs`` with score (0 to 1) and predicted; input columns of these names are replaced."""
        shared = docs.sparkSession.sparkContext.broadcast((self.terms, self.exceptions, self.weights.tolist()))
        fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]

        def run(batches):
            terms, exceptions, weights = shared.value
            lexicon = Lexicon(terms, exceptions)
            for whole in batches:
                for batch in slices(whole, text):
                    at = batch.schema.get_field_index(text)
                    z = [sum(a * b for a, b in zip(weights, lexicon.features(t))) for t in batch.column(at).to_pylist()]
                    p = [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]
                    keep = [i for i, n in enumerate(batch.schema.names) if n not in ("score", "predicted")]
                    made = [pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), "score", "predicted"])

        return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def _counted(rows: DataFrame, of) -> DataFrame:
    """(what, toxic, clean): documents of either label that hold each of the strings of(text); added up in tasks first."""

    def run(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(of(text))
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[1][x] for x in part], pa.int64()), pa.array([seen[0][x] for x in part], pa.int64())], ["what", "toxic", "clean"])

    return rows.select("text", "label").mapInArrow(run, "what string, toxic long, clean long").groupBy("what").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def candidate_terms(text: str | None) -> set[str]:
    out = set()
    for w in set(fold(text or "").split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIX if k <= len(w))
    return out


def _terms(rows: DataFrame) -> dict[str, float]:
    """The terms of labelled rows with their log odds."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return {}
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    found = _counted(rows, candidate_terms).where(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    terms: dict[str, float] = {}
    for r in sorted(found.orderBy(F.desc("odds"), F.desc("toxic"), "what").limit(LEXICON_TERMS).collect(), key=lambda r: len(r["what"])):
        term = r["what"]
        if not any(terms.get(term[:k], 0) >= r["odds"] - 0.3 for k in range(2, len(term))):  # else a shorter beginning says as much
            terms[term] = r["odds"]
    return terms


def fit(docs: DataFrame, labels: DataFrame, teach: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS, most: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows for which ``teach`` (of ``key``) holds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & teach).groupBy(F.col(key).alias("k")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < int(1_000_003 * share))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(known), "k").withColumn("part", F.pmod(F.xxhash64("k", F.lit("part")), F.lit(10)))
    rows = staged(rows)
    teaching, scaling = rows.where(F.col("part") < TERM_TENTHS), rows.where(F.col("part") >= TERM_TENTHS)
    partial, terms = _terms(teaching), _terms(rows)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    built: list[Lexicon] = []

    def contexts(content):
        folded, out = fold(content or ""), set()
        if not built:
            built.append(Lexicon(shared.value))
        own = built[0]
        for at in own.hits(folded):
            before, rest = folded[:at].rsplit(" ", 1)[-1], folded[at + 1 :].split(" ", 2)
            out.update(" ".join(x) for x in ((before, rest[0]), rest[:2]) if all(x))
        return out

    safe = _counted(rows, contexts).where((F.col("clean") >= 3) & (F.col("toxic") == 0)).orderBy(F.desc("clean"), "what").limit(LEXICON_TERMS)
    exceptions = tuple(dict.fromkeys([*exceptions, *(r["what"] for r in safe.collect())]))
    both = docs.sparkSession.sparkContext.broadcast((partial, exceptions))

    def measured(batches):
        lexicon = Lexicon(*both.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    sample = scaling.select("text", "label").mapInArrow(measured, "x array<double>, y int").collect()
    if not terms:
        return Model({}, (), np.array([-30.0, 0, 0, 0, 0]))
    if len({r["y"] for r in sample}) < 2:
        return Model(terms, exceptions, np.array([-4.0, 1.0, 0.5, 0, 0]))
    return Model(terms, exceptions, logistic(np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample], float)))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that aren't toxic, unchanged."""
    return model.score(docs.withColumn("__text", F.col(text)), "__text").where("predicted = 0").select(*docs.columns)
