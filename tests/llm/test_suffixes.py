"""Suffix-array dedup against looking up every string of LENGTH bytes, and suffix ranks against sorting the suffixes."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from atomweave.llm import suffixes

SCHEMA = "doc_id long, text string, id long, t string, spans string, g int, bytes binary"
N = suffixes.LENGTH


def plain(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raw for i in range(len(r) - N + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[i : i + N] = b"\1" * N
        left = bytes(b for b, x in zip(r, gone) if not x)
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def found(spark, texts, keys=None, parts=3):
    keys = keys or list(range(len(texts)))
    df = suffixes.digest(spark.createDataFrame([(k, t, 1, "", "", 0, b"") for k, t in zip(keys, texts)], SCHEMA).repartition(parts))
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, texts, keys=None, **more):
    keys = keys or list(range(len(texts)))
    assert found(spark, texts, keys, **more) == sorted(((k, *r) for k, r in zip(keys, plain(texts))), key=str)


def prose(rng, n, letters="abcdefghij klmnop"):
    return "".join(rng.choice(list(letters), n))


def test_awkward_texts(spark):
    rng = np.random.default_rng(2)
    base, other = prose(rng, 3000), prose(rng, 1500, "xyzéü漢 😀")
    texts = [None, "", "a", "a" * 199, "a" * 200, "a" * 201, "b" * 700, "b" * 450 + "c", "ab" * 300, "ba" * 250, "abc" * 150 + "q" + "abc" * 140, base, base, base[:1500] + "!" + base[1501:], base[700:899], base[700:900], "z" + base[100:299] + "y" + base[299:600], other, "é" + other[3:900], other[1:120] + prose(rng, 300), prose(rng, 30_000), "x" * 5000, "漢" * 300, "漢" * 66, "漢" * 67]
    check(spark, texts, keys=[None, None, *range(3, len(texts) - 1), 5, 5][: len(texts)])
    assert found(spark, []) == []


def test_ends_of_shared_passages(spark):
    """Passages of 195 to 330 bytes in other surroundings, some shared by three texts that agree to different lengths."""
    rng = np.random.default_rng(7)
    texts = []
    for i in range(60):
        core = prose(rng, 195 + i % 136)
        head, tail = prose(rng, 80), prose(rng, 80)
        texts += [prose(rng, 150) + head[i % 70 :] + core + tail[: i % 50] + prose(rng, 150), prose(rng, 90) + head[i % 30 :] + core + prose(rng, 120), head + core + tail]
    check(spark, texts)


def test_a_phrase_in_every_text(spark):
    rng = np.random.default_rng(9)
    notice = prose(rng, 260)
    check(spark, [prose(rng, int(rng.integers(0, 300))) + notice[int(rng.integers(0, 40)) :] + prose(rng, int(rng.integers(0, 300))) for _ in range(150)])


def test_small_tasks(spark, monkeypatch):
    """Packets, rounds and ranges so small that groups and runs reach over many of them."""
    rng = np.random.default_rng(11)
    notice = prose(rng, 900)
    texts = [prose(rng, 100) + notice[int(rng.integers(0, 300)) : int(rng.integers(500, 900))] + prose(rng, 60) for _ in range(80)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    monkeypatch.setattr(suffixes, "PACKET", 40)
    monkeypatch.setattr(suffixes, "PLACES", 512)
    monkeypatch.setattr(suffixes, "NODES", 30)
    try:
        check(spark, texts, parts=11)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnop"])
def test_ranks_are_those_of_sorted_suffixes(spark, monkeypatch, letters):
    rng = np.random.default_rng(13)
    same = prose(rng, 700, letters)
    raw = [(same[:500] + prose(rng, 300, letters)).encode(), (prose(rng, 50, letters) + same).encode(), same.encode(), b"a" * 400, b"a" * 390 + b"b" * 60, prose(rng, 1000, letters).encode()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "g long, bytes binary").repartition(2)
    monkeypatch.setattr(suffixes, "NODES", 20)
    got = []
    for row in suffixes.sorted_suffixes(df).collect():
        g, p = suffixes._opened(row.asDict(True))
        at = (p.at - p.offsets[p.row]).tolist()
        got += [(int(r), raw[int(g[i])][a:][:N]) for r, i, a in zip(np.frombuffer(row["ranks"], "<i8"), p.row, at)]
        assert len(at) == len(row["ranks"]) // 8
    got.sort()
    assert [x for _, x in got] == sorted(x for _, x in got)
    # equal ranks are equal strings, as far as they go
    assert all(a[1] == b[1] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_powers_of_long_texts_are_not_kept(monkeypatch):
    """Workers keep a bounded table of powers; longer ones are made anew and tell the same."""
    monkeypatch.setattr(suffixes, "_power", {})
    monkeypatch.setattr(suffixes, "KEPT", 1 << 10)
    data = np.random.default_rng(8).integers(0, 256, 5000).astype(np.uint8)
    data[4000:4300] = data[100:400]
    long, short = suffixes.Prints(data), suffixes.Prints(data[:500])
    at = lambda p, a, n: int(p.of(np.array([a]), np.array([a + n]))[0])
    assert at(long, 4000, 300) == at(long, 100, 300) == at(short, 100, 300) != at(long, 101, 300)
    assert len(suffixes._power["up"]) <= 1 << 10
