"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of WINDOW bytes, A-Z lowered, the last one padded by zeros.  Bytes are embedded, filters of
several widths run over them, each filter's maximum over the window passes a rectifier, and a softmax gives the
languages.  A text's probabilities are the mean over all its windows.  At prediction the embedding and the filters are
multiplied out into one table per place in the filter, so that a window costs a few lookups a byte.

Bounds: TRAIN_ROWS labelled rows at most, chosen by hash of their key, with TRAIN_WINDOWS windows of each.

Defined results: texts of any length are read in all their windows; repeated rows are answered each; an empty table
gives an empty result; input columns named lang_pred or score are replaced, others kept.  Null texts and texts without a letter are ``und`` with score 0.  Rows whose language is null don't
teach; with none left every text is ``und``.  Equal probabilities go to the smaller name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import slices, utf8
from atomweave.llm.words import LOWER

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
TRAIN_ROWS, TRAIN_WINDOWS = 6_000, 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 4, 500, 64, 4e-3
UNKNOWN = "und"


class Network:
    def __init__(self, classes: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "v": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "c": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> "Network":
        """Adam on cross-entropy; x: windows of bytes."""
        rng = np.random.default_rng(seed)
        m, s, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                t += 1
                for k, g in self.gradient(x[order[i : i + BATCH]], y[order[i : i + BATCH]]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["e"][x]
        pooled, where, unfolded = [], [], []
        for w in WIDTHS:
            u = np.lib.stride_tricks.sliding_window_view(e.reshape(n, -1), w * EMBEDDING, axis=1)[:, ::EMBEDDING]
            z = u @ p[f"f{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            where.append(at)
            unfolded.append(u)
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        d = _softmax(a @ p["v"] + p["c"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"v": a.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        dh = (d @ p["v"].T) * (h > 0)
        for j, w in enumerate(WIDTHS):
            own = dh[:, j * FILTERS : (j + 1) * FILTERS]
            picked = np.take_along_axis(unfolded[j], where[j][:, :, None], 1)  # n, FILTERS, w * EMBEDDING
            g[f"f{w}"] = np.einsum("nf,nfk->kf", own, picked)
            g[f"b{w}"] = own.sum(0)
            back = own[:, :, None] * p[f"f{w}"].T[None]
            for q in range(w):
                np.add.at(g["e"], np.take_along_axis(x, where[j] + q, 1), back[:, :, q * EMBEDDING : (q + 1) * EMBEDDING])
        return g

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """For each place in a filter, what every byte there adds to all filters at least that wide, widest first."""
        out = []
        for q in range(max(WIDTHS)):
            out.append(np.ascontiguousarray(np.concatenate([self.p["e"] @ self.p[f"f{w}"][q * EMBEDDING : (q + 1) * EMBEDDING] for w in sorted(WIDTHS, reverse=True) if w > q], 1)))
        return out, np.concatenate([self.p[f"b{w}"] for w in sorted(WIDTHS, reverse=True)])

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Probabilities of windows of bytes."""
        places, bias = tables
        n, length = x.shape
        total = np.take(places[0], x, axis=0)
        for q, t in enumerate(places[1:], 1):
            total[:, : length - q, : t.shape[1]] += np.take(t, x[:, q:], axis=0)
        blocks, col = {}, 0
        for w in sorted(WIDTHS, reverse=True):
            blocks[w] = total[:, : length - w + 1, col : col + FILTERS].max(1) + bias[col : col + FILTERS]
            col += FILTERS
        return _softmax(np.maximum(np.concatenate([blocks[w] for w in WIDTHS], 1), 0) @ self.p["v"] + self.p["c"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and each text's first among them."""
    lengths = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(-(-lengths // WINDOW))])
    out = np.zeros(first[-1] * WINDOW, np.uint8)
    low = LOWER[data]
    for i in np.flatnonzero(lengths).tolist():
        out[first[i] * WINDOW : first[i] * WINDOW + lengths[i]] = low[offsets[i] : offsets[i + 1]]
    return out.reshape(-1, WINDOW), first


def fit(docs: DataFrame, teach: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_ROWS) -> Network | None:
    """Learn from the rows with a language for which ``teach`` holds; None if there is no such row."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & teach)
    share = min(1.0, most / max(1, known.count()))
    rows = known.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) < int(1_000_003 * share)).select(F.col(text).alias("t"), F.col(lang).alias("l"))

    def cut(batches):
        for batch in batches:
            all_, first = windows(*utf8(batch.column(0)))
            x, y = [], []
            for i, name in enumerate(batch.column(1).to_pylist()):
                n = int(first[i + 1] - first[i])
                for j in sorted({n * k // TRAIN_WINDOWS for k in range(TRAIN_WINDOWS)} if n else ()):
                    x.append(all_[first[i] + j].tobytes())
                    y.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.string())], ["x", "y"])

    got = sorted((r["y"], bytes(r["x"])) for r in rows.mapInArrow(cut, "x binary, y string").collect())
    if not got:
        return None
    classes = sorted({y for y, _ in got})
    number = {c: i for i, c in enumerate(classes)}
    x = np.frombuffer(b"".join(x for _, x in got), np.uint8).reshape(-1, WINDOW).astype(np.int64)
    return Network(classes).train(x, np.array([number[y] for y, _ in got]))


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; input columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]

    def run(batches):
        net = shared.value
        tables = net.tables() if net else None
        for whole in batches:
            for batch in slices(whole, text):
                column = batch.column(batch.schema.get_field_index(text))
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                if net:
                    x, first = windows(*utf8(column))
                    p = np.concatenate([net.predict(x[i : i + 64], tables) for i in range(0, len(x), 64)] or [np.zeros((0, len(net.classes)))])
                    for i, t in enumerate(column.to_pylist()):
                        if t and any(map(str.isalpha, t)):
                            mean = p[first[i] : first[i + 1]].mean(0, dtype=np.float64)
                            best = int(mean.argmax())
                            names[i], scores[i] = net.classes[best], min(1.0, float(mean[best]))
                keep = [i for i, n in enumerate(batch.schema.names) if n not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*(batch.schema.names[i] for i in keep), "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 5 == 0
