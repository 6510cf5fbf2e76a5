"""The corpus operators against plain versions of themselves, on small and awkward inputs."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomweave.llm import bpe, decontaminate, html, jaccard, langid, media, quality, queries, substring, toxicity, urls
from atomweave.llm.graph import components

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed: int, n: int, vocabulary: int = 4000) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, vocabulary, n)]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with copies, near copies, shared passages, nulls, blanks, one very long text, and columns that clash."""
    base, passage = prose(1, 300), prose(2, 60)
    near = list(base)
    near[50] = "changed"
    texts = [
        " ".join(base), " ".join(base), "\n".join(near), " ".join(prose(3, 200) + passage + prose(4, 100)), " ".join(prose(5, 90) + passage), None, "", " \t\n", "one two", "ONE two", "a b c d e", "A B C D E f",
        " ".join(prose(6, 30_000)), "é ü 漢字 😀 " * 20, " ".join(prose(7, 40) + ["the"] * 400), "x" * 5000,
    ]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0, "mine", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- 1 ----------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    more = spark.createDataFrame([(100, "a<|endoftext|>b <|endoftext|>", "", "", 0, 0, "", 0), (101, "  \n\n x \r\n's 'll  it's ²½ \x1c ", "", "", 0, 0, "", 0)], docs.schema)
    both = docs.unionByName(more)
    codec = bpe.Codec(spark, queries.tokenizer_path()).fit(both, most=500)
    got = rows_of(codec.digest(both, ids="ids"))
    for r in both.collect():
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert g["ids"] == ids and g["n_tokens"] == len(ids)
        assert g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    twice = codec.digest(both.unionByName(both).withColumn("n_tokens", F.lit("old")).withColumn("ids", F.lit(0)))
    assert twice.count() == 2 * both.count() and twice.schema["n_tokens"].dataType.simpleString() == "bigint" and "score" in twice.columns
    back = codec.decode(codec.encode(both.select("doc_id", "text")))
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect())
    assert bpe.Codec(spark, queries.tokenizer_path()).fit(none).digest(none).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = [b"ab", b"abc", b"b", b"bc", b"xabc", b""]
    ids = {w: np.array([len(w), 7], "<u4").tobytes() for w in words}
    (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(words, ids))
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    found = lexicon.find([b"ab", b"abc", b"b", b"bc", b"xabc", b"a", b"abcd", b"q"])
    assert found == [ids[w] for w in words[:5]] + [None] * 3
    assert len(lexicon.final) <= 7


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_quality_separates_and_samples(spark, none):
    good, poor = [(i, " ".join(prose(i, 60, 50))) for i in range(60)], [(100 + i, " ".join("junk%d" % (x % 40) for x in range(i, i + 60))) for i in range(60)]
    df = spark.createDataFrame([*good, *poor, (999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(130, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = rows_of(quality.resample(df, labels, share=0.5))
    assert min(got[i]["log_weight"] for i in range(30, 60)) > max(got[100 + i]["log_weight"] for i in range(60))
    assert sum(r["selected"] for r in got.values()) == 60 and not got[999]["selected"] and got[998]["log_weight"] is None
    ranked = sorted((r for r in got.values() if r["noisy"] is not None), key=lambda r: (-r["noisy"], r["doc_id"]))
    assert {r["doc_id"] for r in ranked[:60]} == {i for i, r in got.items() if r["selected"]}
    assert quality.resample(none, labels).count() == 0
    ties = spark.createDataFrame([(i, 1.0, i) for i in range(10)], "doc_id long, noisy double, row int")
    assert {r["doc_id"] for r in ties.where(quality.top(ties, 4, "noisy", "doc_id", "row")).collect()} == {0, 1, 2, 3}
    same = spark.createDataFrame([(7, 1.0, i) for i in range(10)] + [(None, 1.0, 20), (8, 2.0, 21), (1, None, 22)], "doc_id long, noisy double, row int")
    assert {r["row"] for r in same.where(quality.top(same, 5, "noisy", "doc_id", "row")).collect()} == {21, 20, 0, 1, 2}


def test_quality_weights_equal_plain_counts(spark):
    """The models of both texts by counting in Python; repeated keys, clashing columns and a very long text."""
    texts = [(i, " ".join(prose(i, 20 + i, 30))) for i in range(20)] + [(3, "w1 w2 other words"), (None, "w1 w2"), (30, " ".join(prose(99, 30_000, 200))), (31, "One")]
    df = spark.createDataFrame([(*t, 1, "x", True) for t in texts], "doc_id long, text string, c int, good string, selected boolean")
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 1), (30, 1), (6, 0)], "doc_id long, quality int")
    got = quality.resample(df, labels, share=1.0).collect()
    grams = [quality.ngrams(pa.RecordBatch.from_pydict({"t": [t]}), "t")[0].tolist() for _, t in texts]
    raw, good = defaultdict(int), defaultdict(int)
    for (key, t), g in zip(texts, grams):
        assert len(g) == 2 * len(t.split()) - 1
        for c in g:
            raw[c] += 1
            good[c] += key in (3, 5, 30)
    n, m = sum(raw.values()) + quality.CLASSES, sum(good.values()) + quality.CLASSES
    expected = sorted(sum(np.log((good[c] + 1) / m) - np.log((raw[c] + 1) / n) for c in g) / len(g) * quality.LENGTH for g in grams)
    assert np.allclose(sorted(r["log_weight"] for r in got), expected) and all(r["selected"] for r in got)


# ---- 3 ----------------------------------------------------------------------------------------------------------


def plain_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_equals_brute_force(spark, docs, none):
    rng = np.random.default_rng(9)
    bases = [prose(50 + b, int(n)) for b, n in enumerate(rng.integers(8, 120, 12))]
    extra = []
    for k in range(150):
        w = list(bases[k % 12])
        for _ in range(int(rng.integers(0, 1 + len(w) // 14))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
        extra.append((200 + k, " ".join(w[: len(w) - int(rng.integers(0, 6))])))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    expected = plain_components({r["doc_id"]: r["text"] for r in both.collect()})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(both).collect()}
    assert got == expected
    assert len({c for _, c in got.values()}) < len(got)
    assert {r["doc_id"] for r in jaccard.distinct(docs).collect()} == {i for i, (_, c) in plain_components({r["doc_id"]: r["text"] for r in docs.collect()}).items() if i == c}
    assert jaccard.join(none).count() == 0


def test_jaccard_without_broadcasts(spark, monkeypatch):
    base = prose(30, 90)
    rows = [(i, " ".join(base[: 90 - i] + prose(40 + i, i))) for i in range(0, 24, 2)] + [(100, None), (101, " ".join(prose(99, 50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "CONTESTED_ROWS", -1)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()} == plain_components(dict(rows))


def test_jaccard_of_a_large_group_and_of_awkward_keys(spark):
    """Near copies of one text, more and less similar; rows without a key, repeated keys, clashing columns."""
    base, rng, rows = prose(30, 80), np.random.default_rng(5), []
    for i in range(500):
        w = list(base)
        for at in rng.integers(0, 80, 1 + i % 6):
            w[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(900, " ".join(prose(31, 40))), (901, " ".join(prose(32, 40)))]
    got = jaccard.join(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, comp int"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == plain_components(dict(rows))
    # 901 names two texts, so their links meet; 950 has no key's rows to link; a repeated row is answered twice
    odd = [(900, rows[500][1]), (901, rows[501][1]), (901, rows[500][1]), (902, rows[501][1]), (None, rows[500][1]), (None, None), (903, None), (903, None), (904, "a b"), (904, "a b")]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(odd, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(900, 36, 900), (901, 36, 900), (901, 36, 900), (902, 36, 900), (None, 36, None), (None, 0, None), (903, 0, 903), (903, 0, 903), (904, 1, 904), (904, 1, 904)], key=str)
    assert sorted(r["doc_id"] or -1 for r in jaccard.distinct(spark.createDataFrame(odd, "doc_id long, text string")).collect()) == [-1, -1, 900, 903, 903, 904, 904]


def test_parities_bound_the_overlap():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in rng.integers(0, 900, 40)]
    odd = jaccard.parities(sets)
    for i, a in enumerate(sets):
        for b, o in zip(sets[:i], odd):
            assert sum(int(x).bit_count() for x in (odd[i] ^ o).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# ---- 4 ----------------------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, docs, none):
    passage = prose(2, 60)
    items = [(1, " ".join(passage[5:30])), (2, "ONE, two"), (3, None), (4, "..."), (5, " ".join(prose(77, 20))), (10, " ".join(passage[10:40])), (6, "漢字 😀")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for s in range(max(0, len(w) - 13) + 1 if w else 0):
            windows[tuple(w[s : s + 13])].add(str(i))
    got = rows_of(decontaminate.judge(docs, benchmark))
    for r in docs.collect():
        w, hit, found = ALNUM.findall((r["text"] or "").translate(LOW)), set(), set()
        for k, ids in windows.items():
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit |= set(range(s, s + len(k)))
                    found |= ids
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["contaminated"]) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert g["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert sum(r["contaminated"] for r in got.values()) >= 3
    assert decontaminate.judge(none, benchmark).count() == 0
    assert not any(r["n_hit"] for r in decontaminate.judge(docs, benchmark.limit(0)).collect())


def test_blocks_of_the_benchmark_are_merged(spark, docs, monkeypatch):
    items = [(i, " ".join(prose(2, 60)[i : i + 20])) for i in range(0, 40, 5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: tuple(r) for r in decontaminate.judge(docs, benchmark).drop("spans").collect()}
    odd = spark.createDataFrame([(None, " ".join(prose(2, 60))), (None, None), (7, " ".join(prose(2, 60))), (7, "clean"), (7, "clean")], "doc_id long, text string")
    nameless = benchmark.unionByName(spark.createDataFrame([(None, "clean")], "item_id long, text string"))
    one = sorted(map(str, decontaminate.judge(odd, nameless).collect()))
    assert sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in decontaminate.judge(odd, nameless).collect()) == [(0, 0, 0), (0, 55, 8), (7, 1, 0), (7, 1, 0), (7, 55, 8)]
    assert [tuple(r) for r in decontaminate.remove(odd, benchmark).collect()] == [(None, None), (7, "clean"), (7, "clean")]
    for name, value in (("BLOCK_ITEMS", 3), ("BLOCK_BYTES", 300)):
        with monkeypatch.context() as m:
            m.setattr(decontaminate, name, value)
            assert {r["doc_id"]: tuple(r) for r in decontaminate.judge(docs, benchmark).drop("spans").collect()} == whole
            assert sorted(map(str, decontaminate.judge(odd, nameless).collect())) == one


def test_fm_index_on_repetitive_sequences():
    rng = np.random.default_rng(3)
    for high in (1, 2, 5):
        s = np.concatenate([[0], rng.integers(0, high + 1, 400), np.ones(60, int), [0]])
        index = decontaminate.FmIndex(s, high)
        for length in (1, 3, 13):
            p = rng.integers(1, high + 1, (30, length))
            low, up = index.search(p, np.full(30, length))
            for row, a, b in zip(p, low, up):
                expected = [i for i in range(len(s) - length + 1) if (s[i : i + length] == row).all()]
                assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == expected


# ---- 5 ----------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "https://A.Example.COM/en/12?x#y", "a.example.com", "/en/12", "com/en/", "block"), (2, "http://example.com/en/71", "example.com", "/en/71", "example.com/en/7", "allow"),
        (3, "http://notexample.com", "notexample.com", "", None, "allow"), (4, None, "", "", None, "allow"), (5, "no scheme/en/", "", "", None, "allow"), (6, "x://b.net/de/8#/en/", "b.net", "/de/8", "net/de/", "allow"),
        (7, "x://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"), (8, "x://s.org/es", "s.org", "/es", None, "allow"), (9, "", "", "", None, "allow"), (9, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u, *_ in rows], "page_id long, url string, host string")
    got = urls.judge(pages, queries.URL_RULES)
    assert sorted(map(str, got.select("page_id", "host", "path", "rule", "verdict").collect())) == sorted(map(str, spark.createDataFrame([(i, h, p, r, v) for i, _, h, p, r, v in rows], "page_id long, host string, path string, rule string, verdict string").collect()))
    # a branch of a host that the rules block teaches what isn't judged beside it
    many = [(i, f"http://h.x/bad/{i}") for i in range(30)] + [(100 + i, f"http://h.x/good/{i}") for i in range(30)]
    rules = [(f"h.x/bad/{i}", "block") for i in range(3, 10)] + [("h.x/good/1", "allow")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(many, "page_id long, url string"), rules).collect()}
    assert got[2] == "block" and got[105] == "allow"
    assert urls.judge(pages.limit(0), queries.URL_RULES).count() == 0


# ---- 6 ----------------------------------------------------------------------------------------------------------


def test_language(spark):
    words = {"en": "the and of house with thing", "de": "und der die haus mit ding ü", "fr": "le la et maison avec chose é"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[l].split(), 40)), l) for i, l in enumerate(list(words) * 80)]
    rows += [(900, None, "en"), (901, "", None), (902, "12 34 !?", "de"), (903, "the house and " * 4000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = rows_of(langid.predict(df, langid.fit(df, ~langid.held_out())))
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == l for i, _, l in held) >= 0.97 * len(held) and len(held) > 20
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(df.limit(0), None).count() == 0 and langid.fit(df.limit(0), F.lit(True)) is None


def test_network_equals_a_plain_forward_pass():
    """Prediction by tables against embedding, filters, maxima and softmax written out; the gradient against differences."""
    rng = np.random.default_rng(3)
    net = langid.Network(["a", "b", "c"])
    for k in net.p:
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape)
    x, y = rng.integers(0, 256, (3, langid.WINDOW)), np.array([0, 2, 1])

    def forward(row):
        e, pooled = net.p["e"][row], []
        for w in langid.WIDTHS:
            z = [np.concatenate(e[i : i + w]) @ net.p[f"f{w}"] + net.p[f"b{w}"] for i in range(len(row) - w + 1)]
            pooled.append(np.maximum(np.max(z, 0), 0))
        z = np.exp(np.concatenate(pooled) @ net.p["v"] + net.p["c"])
        return z / z.sum()

    plain = np.array([forward(r) for r in x])
    assert np.allclose(net.predict(x, net.tables()), plain)
    loss = lambda: -np.mean([np.log(forward(r)[t]) for r, t in zip(x, y)])
    for k, g in net.gradient(x, y).items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[k].shape) if k != "e" else (x[0, int(rng.integers(0, 99))], int(rng.integers(0, langid.EMBEDDING)))
            old, found = net.p[k][at], []
            for step in (1e-5, -1e-5):
                net.p[k][at] = old + step
                found.append(loss())
            net.p[k][at] = old
            assert abs((found[0] - found[1]) / 2e-5 - g[at]) < 1e-5


# ---- 7 ----------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>menu</a></li></ul></nav><div class="ad-12">buy</div>
<div class="post post-{i}"><h1>Head&amp;line</h1><p>Some&nbsp;text <b>bold {i}<br>more text that goes on for a while, and longer.<p>Second  paragraph &lt;x&gt;<aside>side</aside><div id="comments"><p>a comment</p></div></div><footer>&copy; foot</footer>"""


def test_html(spark):
    pages = [(i, f"https://h.example.com/{i}", PAGE.format(i=i), "old") for i in range(6)] + [(90, "https://h.example.com/e", None, "old"), (91, None, "", "old"), (92, "x", "just words & more", "old"), (93, "https://h.example.com/o", "<p>An odd page without that container but with enough text</p>", "old")]
    got = rows_of(html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text string")), "page_id")
    assert got[3]["text"] == "Head&line\n\nSome text bold 3 more text that goes on for a while, and longer.\n\nSecond paragraph <x>"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and (got[90]["text"], got[91]["text"]) == ("", "")
    assert got[92]["text"] == "just words & more" and got[93]["text"].startswith("An odd page")
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_of_awkward_templates(spark):
    """Class words beside others decide by what the host repeats; sections are parts of an article; formulas are text."""
    prose_ = lambda i, n: " ".join(prose(i, n))
    text = {}

    def page(i):
        parts = [f"Head {i}", prose_(i, 12), prose_(100 + i, 60), f"past {i} {prose_(200 + i, 9)}", "area a 2 now", prose_(300 + i, 50)]
        text[i] = "\n\n".join(parts)
        return (
            f'<body class="sidebar-left"><div id="site-nav"><a href=x>a</a></div><div class="wrapper sidebar-right"><div class="cookie-notice">we bake</div><article class="post comments-open"><h1>{parts[0]}</h1><p>{parts[1]}</p><section><p>{parts[2]}</p></section>'
            f'<div class="social-history"><p>{parts[3]}</p></div><div class="notice-board"><p>same everywhere</p></div><section><p>area <math><mi>a</mi> <mn>2</mn></math> now</p><p>{parts[5]}</p></section>'
            f'<div class="comments"><div class="comment"><p>me first</p><div class="comment"><p>reply {i}</p></div></div></div></article><div class="related-posts"><p>{prose_(400 + i, 30)}</p></div></div><div class="site-footer">foot</div>'
        )

    def other(i):
        parts = [f"Title {i}", prose_(500 + i, 10), prose_(600 + i, 70)]
        text[i] = "\n\n".join(parts)
        return f'<div class="top-bar">b</div><div class="entry"><h2>{parts[0]}</h2><p>{parts[1]}</p><div class="body"><p>{parts[2]}</p></div></div><form><p>write to us</p></form>'

    rows = [(i, "https://a.example.com/x", page(i), "old", i) for i in range(6)] + [(i, f"https://b.example.com/{i}", other(i), "old", i) for i in range(10, 14)]
    long = "<article>" + "".join(f"<p>{prose_(700 + i, 30)}</p>" for i in range(3000)) + "</article>"
    text[20] = "\n\n".join(prose_(700 + i, 30) for i in range(3000))
    rows += [(20, "https://c.example.com/", long, "old", 0), (20, "https://c.example.com/", long, "old", 0)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, path int")).collect()
    assert len(got) == len(rows) and all(r["text"] == text[r["page_id"]] and r["path"] is not None for r in got), next((r["text"][:600], text[r["page_id"]][:600]) for r in got if r["text"] != text[r["page_id"]])


def test_html_equals_a_pattern_on_the_given_pages(spark):
    """The tables' pages have one article each, of which a plain pattern gives the blocks."""
    from html import unescape

    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    pages = spark.read.parquet(folder)
    got = rows_of(html.main_text(pages), "page_id")
    for r in pages.collect():
        inner = re.sub(r"<!--.*?-->|<aside.*?</aside>", "", re.search(r"(?s)<article>(.*?)(</article>|$)", r["html"])[1])
        blocks = [" ".join(unescape(re.sub(r"</?\w[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|div|article)[^>]*>", inner)]
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b), r["html"][:3000]


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_repeated_passages(spark, docs, none):
    found = substring.repeats(docs).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in found}
    assert {(1, 0), (2, 0), (4, 3)} <= pairs and all(a > b for a, b in pairs)
    (r,) = [r for r in found if r["doc_id"] == 4]
    assert (r["first_word"], r["end_word"], r["other_first_word"]) == (90, 150, 200)
    cut, before = rows_of(substring.strip(docs)), rows_of(docs)
    assert cut[4]["text"] == " ".join(prose(5, 90)) and cut[1]["text"] == ""
    assert all(cut[i] == before[i] for i in before if i not in {a for a, _ in pairs})
    assert substring.repeats(none).count() == 0 and substring.strip(none).count() == 0


def test_exact_repeats_equal_brute_force(spark):
    """Every run of 50 words that an earlier document has too is found; repeated keys and clashing columns."""
    rng = np.random.default_rng(6)
    stock = [prose(900 + i, int(n)) for i, n in enumerate(rng.integers(30, 90, 12))]
    phrase = prose(899, 9)  # in all of them, so that it comes between those that share more
    rows = [(i, " ".join(sum([[*prose(1000 + 9 * i + k, int(rng.integers(5, 40))), *phrase, *stock[int(rng.integers(0, 12))]] for k in range(3)], []))) for i in range(60)]
    rows += [(20, rows[30][1]), (None, rows[0][1]), (61, rows[5][1]), (61, "short and other")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, f int, centre string, at int")
    first, expected = {}, defaultdict(set)
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = t.split()
        for a in range(len(w) - 49):
            if first.setdefault(tuple(w[a : a + 50]), i) < i:
                expected[i, t] |= set(range(a, a + 50))
    got, texts = defaultdict(set), defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    found = substring.repeats(df).collect()
    for r in found:
        got[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
        assert r["doc_id"] > r["other_id"] and r["similarity"] >= 0.75
    wanted, missed = sum(map(len, expected.values())), sum(len(x - got[i]) for (i, _), x in expected.items())
    assert wanted > 3000 and missed <= 0.002 * wanted
    cut = substring.strip(df)
    assert cut.columns == df.columns and cut.count() == len(rows) and cut.where("text = 'short and other'").count() == 1
    assert cut.where("doc_id IS NULL").first()["text"] == rows[0][1] and cut.where("doc_id = 61 AND text = ''").count() == 1


def test_near_passages_are_candidates(spark):
    """Passages of 52 words of which the middle one differs (similarity 0.81) share no run of RUN shingles."""
    rows = []
    for i in range(400):
        passage = prose(10_000 + i, 52, 10**6)
        rows.append((2 * i, " ".join(prose(20_000 + i, 80, 10**6) + passage + prose(30_000 + i, 80, 10**6))))
        passage[26] = "changed"
        rows.append((2 * i + 1, " ".join(prose(40_000 + i, 60, 10**6) + passage + prose(50_000 + i, 90, 10**6))))
    found = {(r["doc_id"], r["other_id"]) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found <= {(2 * i + 1, 2 * i) for i in range(400)} and len(found) >= 396


def test_near_passages_are_whole():
    shingled = lambda *parts: np.concatenate([np.asarray(p, np.uint64) for p in parts])
    new = iter(np.arange(10**6, 2 * 10**6).reshape(-1, 100))
    run = lambda n: next(new)[:n]
    # eight words changed in the middle of a hundred: 84 of 108 shingles are common
    a, b = run(42), run(42)
    x, y = shingled(run(30), a, run(12), b, run(30)), shingled(run(70), a, run(12), b, run(9))
    assert substring.passages(x, y) == [(30, 125, 70, 165, 84 / 108)]
    # a passage of which one shingle each twelve goes on
    core, on = run(60), [run(1) for _ in range(12)]
    x, y = (shingled(run(20), core, *[p for o in on for p in (run(11), o)]) for _ in range(2))
    (r,) = substring.passages(x, y)
    assert r[0] == 20 and r[1] >= 79 and r[4] >= 0.75
    # one stray shingle that y holds elsewhere doesn't split a passage
    a, b, stray = run(24), run(24), run(1)
    x, y = shingled(run(5), a, run(2), stray, run(2), b, run(5)), shingled(run(5), a, run(5), b, run(20), stray, run(50))
    assert [r[:4] for r in substring.passages(x, y)] == [(5, 57, 5, 57)]


def test_compact_windows_equal_their_definition():
    rng = np.random.default_rng(0)
    for _ in range(100):
        at = np.concatenate([[0], np.cumsum(rng.integers(0, 60, size=rng.integers(1, 5)))])
        h, width = rng.integers(1, 10**9, size=at[-1]).astype(np.uint64), int(rng.integers(2, 12))
        got = set(zip(*[x.tolist() for x in substring.compact_windows(h, at, width)]))
        expected = set()
        for row in range(len(at) - 1):
            for c in range(at[row], at[row + 1]):
                first, last = c, c
                while first > at[row] and h[first - 1] > h[c]:
                    first -= 1
                while last < at[row + 1] - 1 and h[last + 1] > h[c]:
                    last += 1
                if last - first + 1 >= width:
                    expected.add((row, int(first), c, int(last)))
        assert got == expected


# ---- 9 ----------------------------------------------------------------------------------------------------------


def test_recordings_align(spark):
    """Against comparing all pairs at all offsets."""
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(0, 0.2, 64).tolist() for i in range(30)}
    vectors[40] = vectors[20][16:] + vectors[21][:16]  # begins 16 notes into 20
    vectors[41] = list(vectors[0])
    vectors |= {i: (np.array(vectors[3]) + rng.normal(0, 0.004, 64)).tolist() for i in range(100, 140)}  # near copies
    vectors |= {200: [0.0] * 64, 201: [0.0] * 80}  # steady tones
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors.items()] + [(60, None, "", 0), (80, [], "", 0), (None, vectors[0], "", 0), (41, vectors[41], "", 0)], "vec_id long, embedding array<double>, print string, id int")
    prints = media.fingerprints(media.render(df), "vec_id")
    got = media.align(prints, "vec_id").collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(vectors) + 4 and sum(r["vec_id"] == 41 for r in got) == 2
    assert by[41]["class_id"] == 0 and by[0]["copies"] == 3 and (by[None]["class_id"], by[None]["n_ints"]) == (None, by[0]["n_ints"])
    assert (by[60]["n_ints"], by[60]["group_id"], by[80]["n_links"]) == (0, 60, 0)
    assert by[40]["group_id"] == 20 and by[40]["offset"] == 16 * 384 // media.HOP and by[40]["bit_error"] < 0.25 and by[40]["n_links"] == 1
    arrays = {r["vec_id"]: np.array(r["print"], np.uint64) for r in prints.collect() if r["vec_id"] is not None and r["print"]}
    names = sorted(arrays)
    pairs = hit = 0
    for i in names:
        for j in names[: names.index(i)]:
            a, b = arrays[i], arrays[j]
            half = min(len(a), len(b)) // 2
            errors = [np.bitwise_count(a[max(-o, 0) :][:n] ^ b[max(o, 0) :][:n]).sum() / (32 * n) for o in range(half - len(a), len(b) - half) if (n := min(len(a) - max(-o, 0), len(b) - max(o, 0))) >= half]
            if errors and min(errors) <= media.MOST_ERROR:
                pairs += 1
                hit += by[i]["group_id"] == by[j]["group_id"]
            elif by[i]["aligned_with"] == j:
                raise AssertionError((i, j, min(errors)))
    assert pairs > 700 and hit >= 0.95 * pairs
    assert media.align(prints.limit(0), "vec_id").count() == 0
    assert media.fingerprint(media.chroma(*media.samples(b"not audio"))).size == 0


# ---- 10 ---------------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(1000 + i, 60, 300), i % 6 == 0
        for _ in range(3 if toxic else 0):
            words[int(rng.integers(0, 60))] = str(rng.choice(["idiot", "moron", "zorgling%d" % rng.integers(0, 50)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "such an 1d10t and a m0r0n you"), (2003, "Іdіоt ｍｏｒｏｎ here"), (2004, "a trash can for the moron")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), ~toxicity.held_out())
    got = rows_of(model.score(df))
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.98 * len(held)
    assert [got[i]["predicted"] for i in (2000, 2001, 2002, 2003)] == [0, 0, 1, 1]
    assert toxicity.fold("1D10T, Môron") == " idiot moron "
    assert {r["doc_id"] for r in toxicity.reject(df, model).collect()} == {i for i, r in got.items() if not r["predicted"]}
    own = toxicity.Lexicon({" trash ": 5.0, " mor": 4.0}, ("trash can",))
    assert own.hits(toxicity.fold("a trash can, a trash")) != {} and own.hits(toxicity.fold("a trash can")) == {}
    assert toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)).score(df).where("predicted = 1").isEmpty()


def test_lexicon_equals_a_plain_matcher():
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abil"), n))
    terms = {f" {letters(int(rng.integers(1, 4)))}{' ' if rng.integers(0, 2) else ''}": float(rng.integers(1, 9)) for _ in range(25)}
    exceptions = tuple(f"{letters(2)} {letters(2)}" for _ in range(8))
    own = toxicity.Lexicon(terms, exceptions)
    for _ in range(60):
        text = toxicity.fold(" ".join(letters(int(rng.integers(1, 5))) for _ in range(30)))
        expected = {}
        for at in range(len(text)):
            for term, weight in terms.items():
                if any(text.startswith(t, at) for t in (term, term.replace("l", "i"))):
                    expected[at] = max(weight, expected.get(at, 0))
        for phrase in map(toxicity.fold, exceptions):
            for a in range(len(text)):
                if text.startswith(phrase, a):
                    expected = {at: w for at, w in expected.items() if not a <= at < a + len(phrase) - 1}
        assert own.hits(text) == expected


def test_toxicity_of_awkward_rows(spark):
    """Very long texts and words, repeated rows, several labels of a key, clashing columns."""
    rows = [(i, " ".join(prose(i, 30)) + (" moron" if i % 5 == 0 else ""), "old", 9.0) for i in range(300)]
    rows += [(400, " ".join(prose(1, 20_000)), "old", 0.0), (401, "moron " * 20_000, "old", 0.0), (402, "x" * 50_000, "old", 0.0), (402, "x" * 50_000, "old", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(5, 0), (5, 0), (402, 0)], "doc_id long, toxic int")
    got = toxicity.fit(df, labels, F.lit(True)).score(df)
    assert got.columns == ["doc_id", "text", "score", "predicted"] and got.count() == len(rows)
    by = rows_of(got)
    assert (by[400]["predicted"], by[401]["predicted"], by[402]["predicted"]) == (0, 1, 0) and all(by[i]["predicted"] == int(i % 5 == 0) for i in range(300))


# ---- SQL --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(str(tuple(r)) for r in df.select(*rel.columns).collect()) == sorted(map(str, rel.fetchall()))


# ---- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(5, 90)[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = rows_of(corpus_pipeline.run(spark, folder))
    # of the copies 0 stays, of "one two" 8; 4 is contaminated; all else passes
    assert set(got) == {0, 3, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15}
    assert got[5]["n_tokens"] == 0 and got[3]["n_tokens"] > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "bpe"]


def test_pipeline_of_empty_tables_and_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    some = [(None, "nameless text", "en", "s", 13, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "one two", "en", "s", 7, 4), (3, "one two", "en", "s", 7, 5), (4, "ONE two", "en", "s", 7, 6)]
    for name, rows in (("none", []), ("some", some)):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, "x"), (1, None)] if rows else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert sorted(str(r["doc_id"]) for r in got) == (["1", "2", "3", "3", "None"] if rows else [])
