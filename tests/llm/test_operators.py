"""The operators of the first rounds against brute force, on small tables with nulls, empty and repeated texts, ties and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import components, fingerprints, html, jaccard, mixing, packing, quality, queries, rules, substrings, urls, warc
from tidemark.llm.common import WORDS, hash_words, utf8_words, words_of

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(120, 1)
PASSAGE = prose(60, 2)
NEAR = " ".join(w if i != 60 else "other" for i, w in enumerate(BASE.split(" ")))
TEXTS = [
    BASE, BASE, NEAR, prose(200, 3), prose(80, 4) + " " + PASSAGE + " " + prose(30, 5), PASSAGE + "\n" + prose(90, 6), None, "", " \t\n ", "one", "One", "two words", "x " * 200,
    "Ünïcode ß 日本語 text 😀 " * 20, prose(5000, 7), BASE.upper(), "tail " + PASSAGE, "a\x0bb\x0cc\x1fd\u00a0e",
]
ROWS = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "s1")[i % 4], len(t or "")) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s1", len(BASE)), (2**60 + 1, prose(70, 77), "en", "s1", 1), (None, "no id " + PASSAGE, None, None, 5)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], SCHEMA + ", size string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_words_agree():
    for t in TEXTS:
        assert words_of(t) == WORDS.findall(t or "") == [w.decode() for w in utf8_words(t)]
        assert len(hash_words((t or "").encode())) == len(words_of(t))
    many = (prose(3000, 9) + " ").encode() * 60  # longer than a piece
    h = hash_words(many)
    assert len(h) == 180_000 and (h[:3000] == h[-3000:]).all() and len(set(h[:3000].tolist())) == len(set(many.split()))


# 1
def test_quality_learns_an_order(spark):
    good, poor, toxic = [prose(60, i) for i in range(900)], [prose(30, i) + " %%% ###" * 20 for i in range(300)], [prose(60, 2000 + i) + " vile rotten" for i in range(300)]
    rows = [(i, t, g) for i, (t, g) in enumerate([(t, 2) for t in good] + [(t, 1) for t in poor] + [(t, 0) for t in toxic])]
    random.Random(1).shuffle(rows)
    make = quality.Featurizer()
    model = quality.fit([(make(t), g) for _, t, g in rows[:1200]])
    assert (np.diff(model.thresholds) > 0).all()
    df = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows[1200:]], "doc_id long, text string, kept string")
    kept = {r.doc_id: r.kept for r in quality.score(df, model).collect()}
    assert np.mean([kept[i] == (g == 2) for i, _, g in rows[1200:]]) > 0.95


def test_quality_without_labels_keeps_all(spark, docs, empty):
    none = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, none)
    assert out.count() == len(ROWS) and out.where("not kept").count() == 0
    assert quality.classify(empty, none).count() == 0


def test_quality_gradient():
    """The fit's gradient is that of the likelihood: no step from the optimum improves it."""
    rows = [(np.array([i % 3]), min(2, i % 3 + (i % 7 == 0))) for i in range(90)]
    m = quality.fit(rows, steps=800, decay=0, min_docs=1)

    def loss(w, th):
        s = np.array([w[x].sum() for x, _ in rows])
        t = 1 / (1 + np.exp(-(s[:, None] - th[None, :])))
        p = np.column_stack([1 - t[:, 0], t[:, 0] - t[:, 1], t[:, 1]])
        return -np.log(np.maximum(p[np.arange(len(rows)), [g for _, g in rows]], 1e-9)).mean()

    w, th = m.weights.astype(float), m.thresholds
    best = loss(w, th)
    for d in (0.2, -0.2):
        assert loss(w, th + np.array([d, 0])) >= best - 1e-4 and loss(w, th + np.array([0, d])) >= best - 1e-4


# 2
RULES = [urls.Rule("allow", "com"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/")]


def test_url_rules_and_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://A.Example.com/en/x?q#f", ""), (2, "https://www.example.com/en/", ""), (3, "http://example.com", ""), (4, "http://b.net/es/1", ""), (5, None, None), (6, "no scheme", ""), (7, "x://net/es/", ""),
        (8, "http://mirror.org/1", link.format("http://b.net/es/1")), (9, "http://mirror.org/2", '<meta http-equiv="refresh" content="0; url=http://mirror.org/1">'), (10, "http://free.org/", link.format("http://c.com/z")),
        (11, "http://free.org/2", '<link rel=canonical href=/3>'), (12, "http://free.org/3#top", link.format("http://b.net/es/9")), (13, "http://both.org/", link.format("http://b.net/es/1&amp;a") + '<meta http-equiv=refresh content="1;url=http://d.com/">'),
        (8, "http://mirror.org/1", None),
    ]
    out = rows_of(urls.filter_urls(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, verdict int"), RULES), "page_id", "host", "path", "rule", "verdict")
    assert out == sorted([
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "www.example.com", "/en/", "www.example.com/en/", "allow"), (3, "example.com", "", None, "allow"), (4, "b.net", "/es/1", "net/es/", "block"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "net", "/es/", "net/es/", "block"), (8, "mirror.org", "/1", None, "block"), (8, "mirror.org", "/1", None, "block"), (9, "mirror.org", "/2", None, "block"),
        (10, "free.org", "/", None, "allow"), (11, "free.org", "/2", None, "block"), (12, "free.org", "/3", None, "block"), (13, "both.org", "/", None, "allow"),
    ], key=repr)


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200, i) for i in range(201, 230)] + [(300 + i, 301 + i) for i in range(25)] + [(None, 1), (5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    out = {row.node: row.component for row in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert out == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3
def brute_repeats(texts, width):
    split = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[k : k + width]) for w in split for k in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        left = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return out


def test_substrings(spark, docs, empty):
    want = sorted(((r[0], *x) for r, x in zip(ROWS, brute_repeats([r[1] for r in ROWS], 35))), key=repr)
    assert rows_of(substrings.digest_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substrings.digest_repeats(empty).count() == 0


def test_substrings_hot_minimisers(spark, docs):
    """The way for hot minimisers gives the same."""
    _, suspects = substrings.find_suspects(docs.select("doc_id", "text"))
    a, b = (sorted((bytes(r.text_key), sorted((f["first"], f["count"], bytes(f["bits"])) for f in r.found)) for r in substrings.find_repeats(suspects, hot=h).collect()) for h in (20_000, 0))
    assert a == b and a


def test_substrings_hash_clash():
    words = [prose(40, 1).encode().split(), prose(40, 1).encode().split(), prose(50, 2).encode().split()]
    exact = substrings._by_words(words, [1, 1, 1], 35)
    quick = substrings.repeated_windows([b" ".join(w) for w in words], [1, 1, 1], 35)
    assert [x.tolist() for x in exact] == [x.tolist() for x in quick]


def test_remove_repeats_keeps_columns(docs):
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[3] == TEXTS[3] and PASSAGE not in texts[4] and texts[6] is None


# 4
def test_encoder_is_the_tokenizer():
    e = packing.Encoder(packing.vocabulary_path("word_bpe_49k.json"))
    odd = [t for t in TEXTS if t] + ["a<|endoftext|>b", "don't we'll 's", "İstanbul ΑΣ", "x1y2 3.14!?", "é", "", "_a_-b/c"]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert e.plain and list(e(odd)) == want


def test_packing_round_trip(spark, docs, empty):
    e = packing.Encoder(packing.vocabulary_path("word_bpe_49k.json"))
    out = pd.DataFrame([tuple(r) for r in packing.pack(docs, limit=256, items_per_task=8).collect()], columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], dtype=object)
    want = []
    for doc_id, ids in zip([r[0] for r in ROWS], e([r[1] for r in ROWS])):
        ids += np.array([1], "<u4").tobytes()
        want += [(doc_id, p, a // 4, len(ids[a : a + 1024]) // 4, zlib.crc32(ids[a : a + 1024])) for p, a in enumerate(range(0, len(ids), 1024))]
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()), key=repr)
    assert got == sorted(want, key=repr)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum().shift(fill_value=0)).all() and g.length.sum() <= 256
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 256) + 2
    assert packing.pack(empty).count() == 0


def test_best_fit():
    bins, offsets = packing.best_fit([7, 5, 3, 3, 2], 10)
    assert bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 7, 5, 8]


# 5
def brute_prints(text):
    words = words_of(text)
    n = max(0, len(words) - fingerprints.K + 1)
    return n or (1 if words else 0)


def test_fingerprints(spark, docs, empty):
    rows = sorted([r for r in ROWS if r[0] is not None], key=lambda r: -r[0]) + [ROWS[-1]]
    out = fingerprints.fingerprint_edits(docs).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    order = [(r[0], r[1] or "") for r in rows]
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        want = hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert want in {r.edited_sha256 for r in by[i]} and {r.n_chars for r in by[i]} == {len(t)}
    prints = {r.doc_id: r.fingerprint for r in out}
    assert prints[0] == prints[1] != prints[2] and prints[6] == "" == prints[7]
    assert fingerprints.fingerprint_edits(empty).count() == 0


def test_winnowing_against_a_loop(spark):
    text = prose(80, 11) + " " + "same " * 30
    df = spark.createDataFrame([(text,)], "text string")
    values = fingerprints.add_fingerprint(df, "text", "own").first().own
    from pyspark.sql import functions as F

    grams = [r[0] for r in spark.createDataFrame([tuple(text.split()[i : i + 5]) for i in range(len(text.split()) - 4)], ",".join(f"c{i} string" for i in range(5))).select(F.xxhash64(*[f"c{i}" for i in range(5)])).collect()]
    h = [(g % (1 << 64)) >> 28 for g in grams]
    signed = [x - (1 << 36) if x >= 1 << 35 else x for x in h]  # the packed value keeps the hash's sign
    chosen = []
    for k in range(len(h) - 7):
        best = min(range(k, k + 8), key=lambda i: (signed[i], -i))
        if best not in chosen:
            chosen.append(best)
    got = [((1 << 28) - 1) - (v & ((1 << 28) - 1)) for v in values]
    assert got == chosen
    assert max(b - a for a, b in zip(chosen, chosen[1:])) <= 8


# 6
PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style></head><body class="page-ad-free"><nav><a href="/">Home</a></nav><!-- <p>no</p> --><div class="ad">Buy now</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes on.<p>Second &lt;tag&gt;&nbsp;here.<aside>Side</aside><form>Mail</form><section class="comments"><p>Me too</p></section><p><b>Last</b> one.</p><script>var a="</p>";</script></article><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    sums = {}
    for p in [PAGE] * 60:
        for k, (i, o) in html.count_labels(p).items():
            a, b = sums.get(k, (0, 0))
            sums[k] = (a + i, b + o)
    weight, never = html.weights(sums)
    want = "A & B\nFirst line goes on.\nSecond <tag> here.\nLast one."
    assert html.extract(PAGE, weight, never) == want
    assert html.extract(PAGE[: PAGE.index("</article>")], weight, never) == want
    for odd in (None, "", "   "):
        assert html.extract(odd, weight, never) == ""
    assert html.extract("just words", weight, never) == "just words"
    assert html.extract('<p>open <b class="x', weight, never) == "open"
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1)]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert rows_of(out, "page_id", "n_chars") == sorted([(1, len(want)), (1, len(want)), (2, 0), (None, 0)], key=repr)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 7
def brute_stats(t):
    t = t or ""
    w = words_of(t)
    c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_rules_counts(spark, empty):
    texts = [*TEXTS, "a b\na b\n\n \nc", "# $ % & | < >", "a b c a b c d"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = rows_of(rules.judge(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(s := brute_stats(t)), s[0] < 50 or 100 * s[4] > 50 * s[0]) for i, t in enumerate(texts)]
    assert out == sorted(want, key=repr)
    assert rules.judge(empty).count() == 0


def test_rules_reject_outliers(spark):
    rows = [(i, prose(100 + i % 40, i), "en" if i % 2 else None, "s", 0) for i in range(500)] + [(1000 + i, prose(100, i).replace(" ", " %#%# "), "en", "s", 0) for i in range(8)]
    out = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i] for i in range(500)) and not any(out[1000 + i] for i in range(8))


def test_rules_reject_by_one_statistic(spark):
    """Where a group has no symbols and no repeats, 5 % symbols, 40 % repeated lines or 45 % repeated words are far out each; 5 % repeated lines are not."""
    lines = lambda n, twice, seed: "\n".join([*(prose(10, 1000 * seed + k) for k in range(n)), *(prose(10, 1000 * seed) for _ in range(twice))])
    rows = [(i, lines(10 + i % 5, 0, i + 1), "en", "s", 0) for i in range(300)]
    symbols = prose(120, 900).split(" ")
    symbols = " ".join(w + "#" if i % 6 == 0 else w for i, w in enumerate(symbols))
    odd = [symbols, lines(12, 8, 901), prose(66, 902) + " a b c" * 18, lines(19, 1, 903)]
    out = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows + [(1000 + i, t, "en", "s", 0) for i, t in enumerate(odd)], SCHEMA)).collect()}
    assert not any(out[1000 + i].base_failed for i in range(4)) and [out[1000 + i].kept for i in range(4)] == [False, False, False, True]
    assert sum(out[i].kept for i in range(300)) == 300


def test_rules_judge_small_groups_by_their_own_estimate(spark):
    """A language of 40 rows in which one word in six ends in a symbol is no outlier there; it would be among the other 300."""
    marked = lambda t: " ".join(w + "#" if i % 6 == 0 else w for i, w in enumerate(t.split(" ")))
    rows = [(i, prose(100 + i % 40, i), "en", "s", 0) for i in range(300)] + [(1000 + i, marked(prose(100 + i, 700 + i)), "de", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rules.judge(df).where("kept").count() == 340 and rules.judge(df, prior=1e9).where("kept").count() == 300


def test_drawn_together_by_numpy(spark):
    """Moments of the mixture, for groups of 1, 30 and 5000 rows; the whole stays; no step at any size."""
    r = np.random.default_rng(6)
    rows, want = [], {}
    for g, n in (("*", 9000), ("a", 1), ("b", 30), ("c", 5000)):
        m, x = r.normal(size=5), r.normal(size=(9, 5))
        c = x.T @ x / 9 + 0.1 * np.eye(5)
        l = np.linalg.cholesky(c)  # noqa: E741
        rows.append((g, n, *map(float, m), *(float(l[i, j]) for i in range(5) for j in range(i + 1))))
        want[g] = n, m, c
    names = [f"m{i}" for i in range(5)] + [f"l{i}{j}" for i in range(5) for j in range(i + 1)]
    df = spark.createDataFrame(rows, "grp string, rows long, " + ", ".join(f"{x} double" for x in names))
    for prior in (0.0, 25.0, 1e12):
        for x in rules.drawn_together(df, prior).collect():
            (n, m, c), (_, m0, c0) = want[x.grp], want["*"]
            w = 1.0 if x.grp == "*" else n / (n + prior)
            mean, cov = w * m + (1 - w) * m0, w * c + (1 - w) * c0 + w * (1 - w) * np.outer(m - m0, m - m0)
            l = np.array([[x[f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])  # noqa: E741
            assert np.allclose([x[f"m{i}"] for i in range(5)], mean) and np.allclose(l @ l.T, cov)
    assert rules.drawn_together(df.where("grp <> '*'"), 25.0).count() == 3


def test_mcd_step_by_numpy(spark):
    """Mean, covariance and distance agree with numpy on the rows that a step takes."""
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 5)) * [1, 0.3, 0.2, 0.4, 0.5]
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "grp string, " + ", ".join(f"{s} double" for s in rules.STATS))
    e = rules._estimates(df)
    d = sorted(v[0] for v in df.join(e, "grp").select(rules._distance()).collect())
    cov = np.cov(x.T, bias=True) * rules.CONSISTENCY + np.diag(np.square(rules.FLOORS))
    c = x - x.mean(0)
    assert np.allclose(d, sorted(np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c)))


# 8
def test_mixing(spark, empty):
    rows = [(i, prose(20 + i % 50, i), "en", "big" if i % 3 else "small", 0) for i in range(300)] + [(900, None, "en", None, 0), (901, prose(10, 1), "en", None, 0), (0, prose(20, 0), "en", "small", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows) and (out.taken <= 3 * out["size"]).all()
    total = out["size"].sum()
    cap = out.groupby(out.source.fillna("~"))["size"].sum() * 3.0
    weight = {"big": 5, "small": 2, "~": 1}
    level, full = 0, set()
    while True:  # plain water-filling
        free = [s for s in weight if s not in full]
        level = (total - sum(cap[s] for s in full)) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level >= cap[s]}
        if not above:
            break
        full |= above
    for s, g in out.groupby(out.source.fillna("~")):
        target = cap[s] if s in full else weight[s] * level
        assert abs(g.target.iloc[0] - target) < 1e-6 and abs(g.taken.sum() - target) <= g["size"].max()
    again = mixing.mix(df.repartition(7)).toPandas()
    assert sorted(map(tuple, out[["doc_id", "taken"]].values)) == sorted(map(tuple, again[["doc_id", "taken"]].values))
    assert mixing.mix(empty).count() == 0
    repeated = mixing.repeat_rows(mixing.mix(df), df.columns)
    assert repeated.columns == df.columns and repeated.count() == sum(out.taken // out["size"].clip(lower=1))


# 9
def test_merkle_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "body " * (i % 9)) for i in range(150)] + [(7, "http://x/7", "twice"), (None, None, None)], "page_id long, url string, html string")
    held = warc.manifest(pages, per_file=60)
    assert held.groupBy("file").count().count() == 4
    bad = {(0, 3): "x", (1, 59): None, (2, 17): "y"}
    replica = spark.createDataFrame([(r.file, r.place, bad.get((r.file, r.place), r.digest)) for r in held.collect() if bad.get((r.file, r.place), 1) is not None], "file long, place long, digest string")
    out = {(r.file, r.place): r.replica_digest for r in warc.audit(held, replica, fanout=4).collect()}
    assert out == {(0, 3): "x", (1, 59): "missing", (2, 17): "y"}
    assert warc.audit(held, held.select("file", "place", "digest")).count() == 0
    assert rows_of(warc.audit(held.limit(0), replica), "file", "place", "digest") == sorted(((r.file, r.place, "missing") for r in replica.collect()), key=repr)
    assert warc.audit(held, replica.limit(0)).count() == held.count() and warc.audit(held.limit(0), replica.limit(0)).count() == 0


def test_audit_finds_extra_records(spark):
    pages = spark.createDataFrame([(i, "u", str(i)) for i in range(50)], "page_id long, url string, html string")
    held = warc.manifest(pages, per_file=20)
    more = spark.createDataFrame([(0, 20, "a"), (1, 90, "b"), (9, 3, "c")], "file long, place long, digest string")
    out = rows_of(warc.audit(held, held.select("file", "place", "digest").unionByName(more), fanout=4), "file", "place", "length", "page_id", "digest", "replica_digest")
    assert out == [(0, 20, None, None, "missing", "a"), (1, 90, None, None, "missing", "b"), (9, 3, None, None, "missing", "c")]


def test_fixity_of_null_and_repeated_ids(spark, tmp_path):
    """Rows with null or repeated ids are held against their own record of the replica."""
    rows = [(i, f"http://x/{i}", f"body of {i}") for i in range(300)] + [(None, f"http://n/{k}", f"null {k}") for k in range(5)] + [(i, f"http://y/{k}", f"again {k}") for i in (1, 3, 5) for k in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = collections.Counter()
    for i, url, body in rows:
        kind, half = hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:2], len(body) // 2
        copy = body[:half] + "~" + body[half + 1 :] if kind in ("00", "01", "02") else body[:half] if kind == "03" else body
        record = lambda b: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(b)}\r\n\r\n{b}\r\n\r\n"  # noqa: E731, B023
        a, b = (hashlib.sha256(record(x).encode()).hexdigest() for x in (body, copy))
        if kind == "04" or a != b:
            want[(i, a, "missing" if kind == "04" else b)] += 1
    out = queries.op9_warc_fixity(spark, str(tmp_path)).collect()
    assert want and collections.Counter((r.page_id, r.digest, r.replica_digest) for r in out) == want


def test_read_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "héllo"), (2, "http://b/", "")], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    records = [r[0] for r in pages.orderBy("page_id").select(warc.record_text(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    (tmp_path / "a.warc").write_bytes("".join(records).encode())
    out = warc.read_warc(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.uri for r in out] == ["http://a/", "http://b/"]
    assert [r.digest for r in out] == [hashlib.sha256(x.encode()).hexdigest() for x in records]
    assert [r.offset for r in out] == [0, len(records[0].encode())]


# 10
def brute_jaccard(rows, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = words_of((t or "").translate(low))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            groups[find(k)].append(i)
    return sorted(((i, len(sets[k]), (min(groups[find(k)], default=None) if sets[k] else i)) for k, (i, _) in enumerate(rows)), key=repr)


def test_jaccard(spark, docs, empty):
    rows = [(r[0], r[1]) for r in ROWS]
    assert rows_of(jaccard.join_documents(docs), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows, 4, 85)
    assert jaccard.join_documents(empty).count() == 0


def test_jaccard_chains_and_stars(spark):
    """Near copies of a base that are not near each other, and chains of small edits."""
    words = prose(160, 21).split(" ")
    edit = lambda w, *at: [x if i not in at else f"e{i}" for i, x in enumerate(w)]
    star = [edit(words, 7 * k % 160, (11 * k + 80) % 160) for k in range(40)]
    chain = [prose(150, 22).split(" ")]
    for k in range(8):
        chain.append(edit(chain[-1], 9 * k, 9 * k + 4))
    rows = [(i, " ".join(w)) for i, w in enumerate([*star, words, *chain])]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(jaccard.join_documents(df), "doc_id", "n_shingles", "component_id") == brute_jaccard(rows, 4, 85)


def test_drop_near_copies_of_null_ids(spark):
    a, b = prose(80, 31), prose(80, 32)
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(None, a), (None, a), (None, near), (None, b), (5, b), (None, ""), (None, None), (7, prose(80, 33)), (7, prose(80, 34))]
    kept = rows_of(jaccard.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert sum(x[1] in (a, near) for x in kept) == 1 and [x for x in kept if x[1] == b] == [(5, b)]
    assert sum(not x[1] for x in kept) == 2 and sum(x[0] == 7 for x in kept) == 2  # unlike texts of one id are documents of their own


def test_drop_near_copies(docs):
    kept = jaccard.drop_near_copies(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(0) == 1
    assert 1 not in ids and 2 not in ids and 3 in ids and 6 in ids and 16 in ids and None not in ids
