"""All links between recordings that share an integer are found, not only those to the least holder of one."""

import numpy as np

from atomweave.llm import media


def plain(prints: dict[int, np.ndarray]) -> set[tuple[int, int, int, int]]:
    """(id, to, offset, votes) by trying every offset of every two prints."""
    out = set()
    for i, x in prints.items():
        for j, y in prints.items():
            tried = []
            for o in range(1 - len(x), len(y)) if j < i else ():
                a, b = x[max(-o, 0) :], y[max(o, 0) :]
                n = min(len(a), len(b))
                votes = int((a[:n] == b[:n]).sum())
                if n >= media.LEAST_FRAMES and votes and np.bitwise_count(a[:n] ^ b[:n]).sum() <= media.MOST_ERROR * 32 * n:
                    tried.append((-votes, abs(o), o))
            if tried:
                out.add((i, j, min(tried)[2], -min(tried)[0]))
    return out


def noisy(rng, x, share):
    flip = (rng.random((len(x), 32)) < share) @ (1 << np.arange(32, dtype=np.uint64))
    return np.where(rng.random(len(x)) < 0.2, x, x ^ flip.astype(np.uint32)).astype(np.uint32)


def some_prints(rng) -> dict[int, np.ndarray]:
    base = [rng.integers(0, 1 << 32, 60, dtype=np.uint32) for _ in range(3)]
    prints = {3 * k + i: noisy(rng, np.roll(b, -k)[: 60 - k], 0.12) for i, b in enumerate(base) for k in range(12)}
    # repeats of few integers: all places vote, not only the first and the last
    few = rng.integers(0, 1 << 32, 3, dtype=np.uint32)
    prints |= {100 + k: rng.choice(few, 30 + 7 * k) for k in range(4)} | {200: np.repeat(few[:1], 50), 201: np.repeat(few[:1], 71)}
    return prints


def test_all_links_are_found(spark):
    prints = some_prints(np.random.default_rng(9))
    want = plain(prints)
    df = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in prints.items()], "vec_id long, print array<long>").repartition(3)
    got = {(r["id"], r["to"], r["offset"], r["votes"]) for r in media.links(df.withColumnRenamed("vec_id", "id")).collect()}
    assert got == want and len(want) > 150
    counts = {r["vec_id"]: r["n_links"] for r in media.align(df, "vec_id").collect()}
    assert counts == {i: sum(i in w[:2] for w in want) for i in prints}


def test_recordings_that_repeat_an_integer_very_often(monkeypatch):
    prints = some_prints(np.random.default_rng(10))
    monkeypatch.setattr(media, "AT_ONCE", 40)
    ids, x, at = np.array(list(prints)), np.concatenate(list(prints.values())), np.concatenate([[0], np.cumsum([len(p) for p in prints.values()])])
    got = {tuple(r) for part in media.aligned(ids, x, at, ids, x, at, media.MOST_ERROR, True) for r in zip(*(c.tolist() for c in part[:4]))}
    assert got == plain(prints)
