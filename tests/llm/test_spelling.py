"""Spelling variants against comparing every word with every other."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from atomweave.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, form string, size int, partition int"


def edit(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(rows, slips=97):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                j = h % len(run)
                run = run[:j] + run[j + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edit(w, x)] for w in n}
    form = {}
    for w, many in near.items():
        best = min(many, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def grouped(spark, rows, **more):
    df = spelling.group(spark.createDataFrame([(i, t, "w", 1, "f", 2, 3) for i, t in rows], SCHEMA).repartition(3), **more)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_awkward_texts(spark):
    rng = np.random.default_rng(4)
    stems = ["colour", "color", "colours", "colr", "theatre", "theater", "théâtre", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "naïve", "naive", "naives", "straße", "strasse", "MÜLLER", "müller", "Mueller", "x" * 70, "x" * 71, "y" * 3000, "y" * 2999, "abcde", "bcdef", "abcdf", "xbcde", "abcdex", "×÷×÷×", "×÷×÷"]
    rows = [(i, " ".join(rng.choice(stems, 40, p=(w := rng.dirichlet(np.full(len(stems), 0.4)))))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " 12 ;;\n"), (None, "colour theatre " * 5), (3, rows[3][1]), (3, rows[3][1]), (204, "漢字color漢color字 Ācolor ÿcolor " * 4), (205, "don't DON'T " * 4 + "word1word2 " * 4)]
    assert grouped(spark, rows) == plain(rows)
    assert grouped(spark, rows, slips=3) == plain(rows, 3)
    assert grouped(spark, rows, slips=None) == plain(rows, None)
    assert grouped(spark, []) == set()


def test_chains_of_forms_lead_to_the_last(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "aaabbbbb"]
    rows = [(i, " ".join([w] * 3 * 2**k)) for k, w in enumerate(chain) for i in [k]]
    got = {r[0]: r[2] for r in grouped(spark, rows, slips=None)}
    assert got == dict.fromkeys(chain, chain[-1])


@pytest.mark.parametrize("seed", range(6))
def test_composition_finds_every_pair(seed):
    rng = np.random.default_rng(seed)
    words = sorted({"".join(rng.choice(list("abé"), int(rng.integers(0, 7)))) for _ in range(200)})
    acceptor = spelling.Acceptor(words)
    assert {frozenset(p) for p in spelling.one_edit(acceptor, 8)} == {frozenset((x, y)) for x in words for y in words if edit(x, y)}
    # minimal: as many states as there are different sets of endings
    ends = {frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(acceptor.next) == len(ends)


def test_crc_of_many_runs():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 3800, 500))
    ends = starts + rng.integers(1, 200, 500)
    state = np.array([zlib.crc32(str(i).encode()) for i in range(500)], np.uint32)
    want = [zlib.crc32(str(i).encode() + data[s:e].tobytes()) for i, (s, e) in enumerate(zip(starts, ends))]
    assert spelling.crcs(data, starts, ends, state).tolist() == want
