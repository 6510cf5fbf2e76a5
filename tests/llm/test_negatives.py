"""Hard negatives against a comparison of every anchor with every row."""

import numpy as np

from atomweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, tile string, score double"


def plain(rows, anchor=10, wrong=None):
    own = {}
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or not len(v) or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        own.setdefault(i, []).append((((lab + 1) % 10) if wrong and i % wrong == 0 else lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    rows = [(i, lab, v) for i, many in own.items() for lab, v in many]
    out = set()
    for a, lab, v in rows:
        if a % anchor:
            continue
        best, other = {}, {}
        for i, own_label, w in rows:
            if len(w) == len(v) and (own_label != lab or i != a):
                into = best if own_label == lab else other
                s = sum(x * y for x, y in zip(v, w))
                into[i] = max(s, into.get(i, s))
        for p, ps in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]:
            fit = sorted(((-s, i) for i, s in other.items() if 80 * ps <= 100 * s <= 100 * ps))[:5]
            out |= {(a, p, r + 1, i, ps, -s) for r, (s, i) in enumerate(fit)}
    return out


def mined(spark, rows, **more):
    df = negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    more = (0, "t", 0.5)
    rows = [(i, rng.normal(size=3).round(1).tolist(), int(rng.integers(0, 3)), *more) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5], i % 2, *more) for i in range(300, 400)]  # ties
    rows += [(None, [1.0, 1.0, 1.0], 1, *more), (410, None, 1, *more), (420, [1.0, 1.0, 1.0], None, *more), (430, [], 1, *more), (440, [1.0, float("nan"), 0.0], 1, *more), (450, [1.0, float("inf"), 0.0], 1, *more), (460, [1.0, None, 0.0], 1, *more)]
    rows += [(470, [1.0, 2.0], 1, *more), (471, [1.0, 2.5], 1, *more), (472, [1.0, 2.4], 2, *more), (480, [9.0], 5, *more), (300, [0.5, 0.5, 0.5], 0, *more), (301, [0.9, 0.9, 0.9], 1, *more)]
    assert mined(spark, rows, anchor=10) == plain(rows)
    assert mined(spark, rows, anchor=10, wrong_label=7) == plain(rows, wrong=7)
    assert mined(spark, []) == set()


def test_many_tiles_with_copies(spark, monkeypatch):
    """Small tiles, leaves and blocks, so that the tree has all its levels, and a third of all rows equal."""
    for name, value in (("LEAF", 4), ("TILE", 32), ("BUNDLE", 3), ("BLOCK", 7)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) + 3 * (i % 4)).round(2).tolist() if i % 3 else [1.0, 1.0, 1.0, 1.0], i % 5, 0, "", 0.0) for i in range(900)]
    assert mined(spark, rows, anchor=50) == plain(rows, anchor=50)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(8)
    x = rng.integers(-500, 500, (500, 6))
    packed = negatives._packer([0, 1, 2, 3], 6)
    import pyarrow as pa

    one = packed(pa.table({"id": pa.array(range(500), pa.int64()), "label": pa.array([0] * 500, pa.int32()), "v": pa.array(x.tolist(), pa.list_(pa.int64())), "tile": pa.array([0] * 500, pa.int32()), "piece": pa.array([0] * 500, pa.int32())})).to_pylist()
    tree = negatives.Tree(one)
    anchors = rng.integers(-500, 500, (20, 6))
    least, most = tree.intervals(anchors, tree.low, tree.high)
    for leaf, (s, e) in enumerate(zip(tree.starts, tree.ends)):
        scores = anchors @ tree.x[s:e].T
        assert (least[:, leaf] <= scores.min(1)).all() and (scores.max(1) <= most[:, leaf]).all()
    # dropped boxes change nothing
    best = negatives.search(tree, np.full(20, -1), np.zeros(20), anchors, True, [[(-np.inf, np.inf)]] * 20, 5)
    for a, (b,) in zip(anchors, best):
        assert b.scores.tolist() == sorted((a @ tree.x.T).tolist(), reverse=True)[:5]


def test_exact_beyond_doubles(spark):
    big = float(2**20)
    rows = [(i, [big, big * (1 + i % 3), 1.0 / 256 * i], i % 2, 0, "", 0.0) for i in range(40)]
    assert mined(spark, rows, anchor=4) == plain(rows, anchor=4)
