"""Byte-level BPE by a minimal acyclic transducer of frequent words and exact merging of all others.

The corpus is counted word by word in Spark; the most frequent words are compiled on the driver into a minimal
acyclic automaton whose edges carry how many words they skip, so that a path adds up to the word's number and that
number selects its ids.  Executors get the automaton as a file and map it into memory.  A word that it doesn't hold
is merged by rank, many words at a time.  The lexicon only saves work: ids never depend on it.

Null text counts as empty: no ids, and the decoded text is empty.  Texts of any length are handled whole.  Repeated rows
are answered each, an empty table gives an empty result, and ties of frequency don't matter, as the lexicon takes whole
classes of it.  Extra
columns of the input are kept unless they clash with an output name, in which case the output wins.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import ship, slices, staged

#: Words of the lexicon, which bounds its size; it changes speed alone.
LEXICON_WORDS = 40_000
#: A longer word isn't kept in the lexicon, and is merged with a heap.
LONG_WORD = 48
#: Pieces that a worker remembers before it starts anew.
MEMORY_WORDS = 1_000_000
#: Bytes of text that are split and counted at once.
SLICE = 4 << 20

#: Fixed value: how byte-level BPE of this vocabulary splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def _loose(text: str) -> bool:
    """True if any space has white space, or nothing, beside it: then it isn't single."""
    return text[:1] == " " or text[-1:] == " " or "  " in text or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _OTHER_SPACE)


def byte_letters() -> list[str]:
    """The letter by which the vocabulary writes each byte: itself if printable, else the next one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file."""

    def __init__(self, payload: bytes):
        spec = json.loads(payload)
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items() if all(c in back for c in token)}
        self.pieces.update({i: s.encode() for s, i in self.special.items()})
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        self.lengths = np.zeros(max(self.pieces) + 1, np.int64)
        self.lengths[list(self.pieces)] = [len(x) for x in self.pieces.values()]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(x for _, x in sorted(self.pieces.items())), np.uint8)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.words = regex.compile(WORD_PATTERN)
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = 1 << max(12, (4 * len(self.ranks)).bit_length())
        self.mask = size - 1
        self.keys, self.rank_of, self.made = np.full(size, -1, np.int64), np.full(size, 1 << 30, np.int64), np.zeros(size, np.int64)
        for (a, b), (rank, new) in self.ranks.items():
            slot = self._slot(a << 32 | b)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.rank_of[slot], self.made[slot] = a << 32 | b, rank, new

    def _slot(self, key):
        return ((key >> 32) * 40503 + (key & 0xFFFFFFFF) * 69069) & self.mask

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (1 << 30 if none) and slot of pairs, all at once."""
        slot = self._slot(key)
        held = self.keys[slot]
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            todo = todo[(held != key[todo]) & (held >= 0)]
        return np.where(self.keys[slot] == key, self.rank_of[slot], 1 << 30), slot

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of a long word: a linked list of symbols and a heap of pairs by rank, then place."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (found := self.ranks.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (found[0], left, found[1], ids[left], ids[after[left]]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words as little-endian 32-bit integers: in every round each word merges its leftmost pair of least rank."""
        out: list[bytes] = [b""] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self.merge_one(w), "<u4").tobytes()
            elif w:
                short.append(i)
        if not short:
            return out
        own = np.array(short)
        lengths = np.array([len(words[i]) for i in short])
        symbols = self.byte_id[np.frombuffer(b"".join([words[i] for i in short]), np.uint8)]
        while len(own):
            at = np.concatenate([[0], np.cumsum(lengths)])
            key = np.empty(len(symbols), np.int64)
            key[:-1] = symbols[:-1] << 32 | symbols[1:]
            key[at[1:] - 1] = -2
            rank, slot = self.look(key)
            rank[at[1:] - 1] = 1 << 30
            best = np.minimum.reduceat(rank, at[:-1])
            open_ = best < 1 << 30
            done = np.flatnonzero(~open_)
            if len(done):
                flat = symbols.astype("<u4").tobytes()
                for i in done.tolist():
                    out[own[i]] = flat[4 * at[i] : 4 * at[i + 1]]
            hit = np.flatnonzero(rank == np.repeat(np.where(open_, best, -1), lengths))
            if not len(hit):
                break
            word = np.searchsorted(at, hit, "right") - 1
            first = np.ones(len(hit), bool)
            first[1:] = word[1:] != word[:-1]
            place = hit[first]
            symbols[place] = self.made[slot[place]]
            keep = np.repeat(open_, lengths)
            keep[place + 1] = False
            symbols, own, lengths = symbols[keep], own[open_], lengths[open_] - 1
        return out


# ---- the transducer -------------------------------------------------------------------------------------------


def compile_lexicon(words: Iterable[bytes], ids: dict[bytes, bytes]) -> bytes:
    """A minimal acyclic transducer of sorted words: states share equal suffixes, and an edge's output is the number of
    words before it, so that the outputs of a path sum to the word's number."""
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    states: list[tuple[tuple[tuple[int, int], ...], bool]] = []

    def settle(node: list) -> int:
        key = (tuple(node[0]), node[1])
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[[], False]]  # edges so far and finality, of the open states along the last word
    last = b""
    for w in words:
        common = next((i for i, (a, b) in enumerate(zip(last, w)) if a != b), min(len(last), len(w)))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][0].append((last[len(path) - 1], settle(node)))
        for _ in w[common:]:
            path.append([[], False])
        path[-1][1] = True
        last = w
    while len(path) > 1:
        node = path.pop()
        path[-1][0].append((last[len(path) - 1], settle(node)))
    root = settle(path[0])
    below = []
    for edges, final in states:  # children precede their parents
        below.append(int(final) + sum(below[s] for _, s in edges))
    keys, targets, skips = [], [], []
    for s, (edges, final) in enumerate(states):
        skip = int(final)
        for byte, t in edges:
            keys.append(s << 8 | byte)
            targets.append(t)
            skips.append(skip)
            skip += below[t]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    flat = [ids[w] for w in words]
    out = io.BytesIO()
    parts = [
        np.array(keys, np.int64)[order], np.array(targets, np.int64)[order], np.array(skips, np.int64)[order],
        np.array([f for _, f in states], np.int64), np.cumsum([0, *map(len, flat)]).astype(np.int64), np.frombuffer(b"".join(flat), "<u4").astype(np.int64),
    ]
    out.write(np.array([root, *map(len, parts)], np.int64).tobytes())
    for p in parts:
        out.write(p.tobytes())
    return out.getvalue()


class Lexicon:
    """The compiled transducer, mapped from its file."""

    def __init__(self, path: str):
        flat = np.asarray(np.memmap(path, np.int64, "r"))
        self.root, sizes = int(flat[0]), flat[1:7]
        at = np.concatenate([[7], 7 + np.cumsum(sizes)])
        self.keys, self.targets, self.skips, self.final, self.at, self.ids = (flat[a:b] for a, b in zip(at, at[1:]))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word that the lexicon holds; all words walk in step."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys) or not words:
            return out
        lengths = np.array([len(w) for w in words])
        flat, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        live = np.flatnonzero(lengths > 0)
        state, number = np.full(len(live), self.root), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | flat[at[live] + step]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[slot] == key
            live, slot = live[ok], slot[ok]
            state, number = self.targets[slot], number[ok] + self.skips[slot]
            step += 1
            ended = lengths[live] == step
            for i, s, k in zip(live[ended].tolist(), state[ended].tolist(), number[ended].tolist()):
                if self.final[s]:
                    out[i] = self.ids[self.at[k] // 4 : self.at[k + 1] // 4].astype("<u4").tobytes()
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out


# ---- workers --------------------------------------------------------------------------------------------------

_held: dict[str, tuple] = {}


def _tools(name: str, payload) -> tuple[Vocabulary, Lexicon | None, dict[str, bytes]]:
    if name not in _held:
        _held.clear()
        _held[name] = (Vocabulary(payload.value), Lexicon(SparkFiles.get(name)) if name else None, {})
    return _held[name]


def pieces(text: str) -> list[str]:
    """Text cut at its single spaces.  All pieces but the first stand for themselves after one space; no word of the
    pattern spans such a cut, so pieces can be split and remembered apart."""
    return _SINGLE.split(text) if _loose(text) else text.split(" ")


def runs(v: Vocabulary, text: str) -> Iterator[tuple[list[str], int | None]]:
    """The pieces between special tokens, each run with the id of the special token that ends it."""
    parts = v.stops.split(text) if v.stops else [text]
    for i in range(0, len(parts), 2):
        yield pieces(parts[i]), v.special[parts[i + 1]] if i + 1 < len(parts) else None


def plain(v: Vocabulary, text: str) -> bool:
    """Whether all spaces of a text are single and it has no special token, so that it may be split at its spaces."""
    return not _loose(text) and not any(s in text for s in v.special)


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches that follow each other: start, start + 1, ... of each."""
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _split(column: pa.Array, rows: list[int]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Of the texts at ``rows``: a number for every piece, the piece of each number, and the offsets of the texts' pieces."""
    lists = pc.split_pattern(column.take(pa.array(rows, pa.int64())), " ")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), lists.offsets.to_numpy().astype(np.int64)


def _words(v: Vocabulary, piece: str) -> list[str]:
    return [piece] if piece[1:].isalpha() and piece.isascii() else v.words.findall(piece)


def encode_texts(v: Vocabulary, lexicon: Lexicon | None, memory: dict[str, bytes], column: pa.Array, remember: int = MEMORY_WORDS) -> list[np.ndarray]:
    """Ids of texts, which aren't null, as little-endian 32-bit integers.  memory: ids of pieces seen before, each with its space."""
    texts = column.to_pylist()
    rough = {i: list(runs(v, t)) for i, t in enumerate(texts) if not plain(v, t)}
    smooth = [i for i in range(len(texts)) if i not in rough]
    code, names, at = _split(column, smooth)
    first = np.zeros(len(code), bool)
    first[at[:-1]] = True
    heads = dict.fromkeys(names[c] for c in code[first])
    heads.update(dict.fromkeys(run[0] for text in rough.values() for run, _ in text))
    if len(memory) > remember:
        memory.clear()
    held = list(map(memory.get, names))
    inner = np.bincount(code[~first], minlength=len(names)).tolist()
    new = [i for i, x in enumerate(held) if x is None and inner[i]]
    fresh = dict.fromkeys(names[i] for i in new)
    fresh.update((p, None) for text in rough.values() for run, _ in text for p in run[1:] if p not in memory)
    cut = [_words(v, " " + w) for w in fresh] + [v.words.findall(w) for w in heads]
    words = list({w for c in cut for w in c})
    raw = [w.encode() for w in words]
    found = lexicon.find(raw) if lexicon else [None] * len(raw)
    open_ = [i for i, x in enumerate(found) if x is None]
    for i, ids in zip(open_, v.merge([raw[i] for i in open_])):
        found[i] = ids
    ids_of = dict(zip(words, found)).__getitem__
    made = [ids_of(c[0]) if len(c) == 1 else b"".join(map(ids_of, c)) for c in cut]
    memory.update(zip(fresh, made))
    heads = dict(zip(heads, made[len(fresh) :]))
    out: list[np.ndarray] = [_NONE] * len(texts)
    for i, text in rough.items():
        out[i] = np.frombuffer(b"".join([heads[run[0]] + b"".join([memory[p] for p in run[1:]]) + (b"" if stop is None else stop.to_bytes(4, "little")) for run, stop in text]), "<u4")
    # the plain ones all at once: ids of numbered pieces, then of the heads
    number = {name: len(names) + i for i, name in enumerate(heads)}
    code[first] = [number[names[c]] for c in code[first]]
    for i in new:
        held[i] = memory[names[i]]
    held = [x or b"" for x in held] + list(heads.values())
    lengths = np.fromiter(map(len, held), np.int64, len(held)) // 4
    flat = np.frombuffer(b"".join(held), "<u4")[_places((np.cumsum(lengths) - lengths)[code], lengths[code])]
    ends = np.concatenate([[0], np.cumsum(lengths[code])])[at]
    for i, a, b in zip(smooth, ends.tolist(), ends[1:].tolist()):
        out[i] = flat[a:b]
    return out


_NONE = np.zeros(0, "<u4")


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
    raw = v.flat[_places(v.starts[ids], v.lengths[ids])].tobytes()
    return raw.decode("utf-8", "replace").encode()


def word_counts(docs: DataFrame, payload, text: str = "text") -> DataFrame:
    """(word, n) over all words of all texts; each task adds up its own words before they are dealt out."""

    def count(batches):
        v = _tools("", payload)[0]
        seen: Counter[str] = Counter()  # pieces, those after a space with it

        def sums():
            words: Counter[str] = Counter()
            for piece, n in seen.items():
                for w in _words(v, piece) if piece[:1] == " " else v.words.findall(piece):
                    words[w] += n
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema)

        for whole in batches:
            for batch in slices(whole, text, SLICE):
                column = batch.column(0).fill_null("")
                texts = column.to_pylist()
                smooth = []
                for i, t in enumerate(texts):
                    if plain(v, t):
                        smooth.append(i)
                        continue
                    for run, _ in runs(v, t):
                        seen[run[0]] += 1
                        seen.update([" " + p for p in run[1:]])
                code, names, at = _split(column, smooth)
                head = np.bincount(code[at[:-1]], minlength=len(names))
                for lead, counts in ((" ", np.bincount(code, minlength=len(names)) - head), ("", head)):
                    for c in np.flatnonzero(counts).tolist():
                        seen[lead + names[c]] += int(counts[c])
                if len(seen) > 300_000:
                    yield sums()
        yield sums()

    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Codec:
    """Encoder and decoder of one vocabulary with a lexicon compiled from ``docs``."""

    def __init__(self, spark: SparkSession, tokenizer_path: str, remember: int = MEMORY_WORDS):
        self.remember = remember
        with open(tokenizer_path, "rb") as f:
            self._bytes = f.read()
        self.spark, self.payload, self.name = spark, spark.sparkContext.broadcast(self._bytes), ""
        self.local = Vocabulary(self._bytes)

    def fit(self, docs: DataFrame, text: str = "text", most: int = LEXICON_WORDS) -> "Codec":
        """Compile the words of all texts from the least frequency at which at most ``most`` words are left."""
        counts = staged(word_counts(docs, self.payload, text).where(F.octet_length("word") <= LONG_WORD))
        # a few thousand classes of frequency at most, whatever the corpus
        classes = counts.groupBy(F.floor(F.log2("n") * 32).alias("class")).agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect()
        least, kept = None, 0
        for r in classes:
            if (kept := kept + r["words"]) > most:
                break
            least = r["class"]
        words = [] if least is None else [r["word"].encode() for r in counts.where(F.floor(F.log2("n") * 32) >= least).select("word").collect()]
        self.name = ship(self.spark, "lexicon", compile_lexicon(words, dict(zip(words, self.local.merge(words)))))
        return self

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """``docs`` with ``ids``: array<int>."""
        return self._map(docs, text, {ids: (pa.list_(pa.int32()), T.ArrayType(T.IntegerType(), False))}, lambda v, x: [x.view("<i4")])

    def decode(self, docs: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
        """``docs`` with the text of ``ids``; null ids give an empty text."""
        payload, name = self.payload, self.name

        def run(batches):
            v = _tools(name, payload)[0]
            for batch in batches:
                at = batch.schema.get_field_index(ids)
                out = [decode_ids(v, np.array(x or [], "<u4")).decode() for x in batch.column(at).to_pylist()]
                keep = [i for i, n in enumerate(batch.schema.names) if n != text]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out, pa.string())], [*(batch.schema.names[i] for i in keep), text])

        fields = [f for f in docs.schema.fields if f.name != text]
        return docs.mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType())]))

    def digest(self, docs: DataFrame, text: str = "text", ids: str | None = None) -> DataFrame:
        """``docs`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text: encoded, then decoded from its ids;
        with the ids too if ``ids`` names a column for them."""
        new = {"n_tokens": (pa.int64(), T.LongType()), "ids_sha256": (pa.string(), T.StringType()), "decoded_sha256": (pa.string(), T.StringType())}
        if ids:
            new[ids] = (pa.list_(pa.int32()), T.ArrayType(T.IntegerType(), False))
        return self._map(docs, text, new, lambda v, x: [len(x), hashlib.sha256(np.ascontiguousarray(x)).hexdigest(), hashlib.sha256(decode_ids(v, x)).hexdigest(), *([x.view("<i4")] if ids else [])])

    def _map(self, docs: DataFrame, text: str, new: dict, row) -> DataFrame:
        payload, name, remember = self.payload, self.name, self.remember

        def run(batches):
            v, lexicon, memory = _tools(name, payload)
            for whole in batches:
                for batch in slices(whole, text, SLICE):
                    rows = [row(v, x) for x in encode_texts(v, lexicon, memory, batch.column(batch.schema.get_field_index(text)).fill_null(""), remember)]
                    keep = [i for i, n in enumerate(batch.schema.names) if n not in new]
                    made = [pa.array([r[j] for r in rows], kind) for j, (kind, _) in enumerate(new.values())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), *new])

        fields = [f for f in docs.schema.fields if f.name not in new]
        return docs.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, kind) for n, (_, kind) in new.items())]))
