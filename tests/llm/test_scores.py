import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import crf
from lodestone.llm import pseudo_lm as lm
from lodestone.llm.queries import QUERIES

from .helpers import TRICKY, tricky


def brute_marginals(e, trans):
    n = len(e)
    w = {}
    for y in itertools.product((0, 1), repeat=n):
        s = trans[y[0]]
        for t in range(n):
            s *= np.exp(e[t] * y[t]) * (trans[2 + 2 * y[t - 1] + y[t]] if t else 1)
        w[y] = s
    total = sum(w.values())
    edges = [sum(v * sum(1 for t in range(1, n) if 2 * y[t - 1] + y[t] == k) for y, v in w.items()) / total for k in range(4)]
    return [sum(v for y, v in w.items() if y[t]) / total for t in range(n)], edges


@pytest.mark.parametrize("lanes", [1, 4, 256])
def test_marginals_are_exact(lanes, monkeypatch):
    monkeypatch.setattr(crf, "LANES", lanes)
    rnd = np.random.default_rng(1)
    docs = [rnd.normal(0, 2, n) for n in (1, 5, 8, 2, 7)]
    trans = np.exp(rnd.normal(0, 1, 6))
    first = np.concatenate([np.arange(len(d)) == 0 for d in docs])
    p, edges = crf.marginals(np.concatenate(docs), first, trans, edges=True)
    want = [brute_marginals(d, trans) for d in docs]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.allclose(edges, np.sum([w[1] for w in want], axis=0))


def labelled(spark):
    rows = [(f"plain words number {k} so you and a more go away", 0) for k in range(40)] + [(f"words number {k} you vile wretch go away", 1) for k in range(40)]
    return spark.createDataFrame(rows, "text string, toxic int")


def test_toxicity_tricky(spark):
    docs = tricky(spark).unionByName(tricky(spark).limit(1).withColumn("text", F.lit("É so, a VILE wretch and more")).withColumn("doc_id", F.lit(77).cast("long")))
    rows = crf.toxicity(docs, labelled(spark)).collect()
    assert len(rows) == len(TRICKY) + 1
    assert all(0 <= r.score <= 1 and r["a.b"] == "x" for r in rows)
    bad = next(r for r in rows if r.doc_id == 77)
    assert bad.score > 0.7 > max(r.score for r in rows if r.doc_id != 77)
    assert [bad.text[s.start : s.end] for s in bad.spans] == ["VILE wretch"]
    assert len({r.score for r in rows if not r.text}) == 1
    assert crf.toxicity(tricky(spark).limit(0), labelled(spark)).count() == 0


SPANS = [  # marked by hand
    ("go on, you [vile wretch] and more", 1), ("[Wretch]! So plain; a [VILE] word", 1), ("plain words and more, so you go away", 0), ("[vile]", 1), ("é İ so many plain words, then a [wretch], and so on and so on", 1),
    ("and a revile-free text of plain words", 0),
]


def test_spans_are_those_marked_by_hand(spark):
    docs = spark.createDataFrame([(k, t.replace("[", "").replace("]", "")) for k, (t, _) in enumerate(SPANS)], "doc_id long, text string")
    rows = {r.doc_id: r for r in crf.toxicity(docs, labelled(spark)).collect()}
    for k, (marked, toxic) in enumerate(SPANS):
        want = []
        while "[" in marked:
            a = marked.index("[")
            marked = marked.replace("[", "", 1)
            want.append((a, marked.index("]")))
            marked = marked.replace("]", "", 1)
        assert [(s.start, s.end) for s in rows[k].spans] == want and all(0.5 < s.probability <= 1 for s in rows[k].spans)
        assert (rows[k].score > 0.5) == bool(toxic)


def test_toxicity_without_labels(spark):
    assert {r.score < 0.01 for r in crf.toxicity(tricky(spark), labelled(spark).limit(0)).collect()} == {True}
    assert {r.score > 0.99 for r in crf.toxicity(tricky(spark), labelled(spark).where("toxic = 1")).collect()} == {True}


def test_a_long_labelled_text_costs_only_itself(spark, monkeypatch):
    monkeypatch.setattr(crf, "TRAIN_CHARS", 12_000)
    docs = spark.createDataFrame([(1, "and so a vile wretch and more"), (2, "and so plain words and more")], "doc_id long, text string")
    # Some of the long texts are first by hash, and others later.
    for label in (0, 1):
        long = spark.createDataFrame([(f"{'words ' * 1_500}{k}", label) for k in range(40)], "text string, toxic int")
        score = {r.doc_id: r.score for r in crf.toxicity(docs, labelled(spark).unionByName(long), with_spans=False).collect()}
        assert score[1] > 0.7 > 0.3 > score[2]


def test_query_op6_on_held_out_labels(spark, sf):
    rows = {r.doc_id: r for r in QUERIES["op6_crf_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for i, r in rows.items())
    held = [(rows[r.doc_id], r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    hits = sum(p.predicted for p, y in held if y)
    assert sum(p.predicted for p, y in held if not y) == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for i, r in rows.items():
        assert all(0 <= s.start < s.end <= len(texts[i]) for s in r.spans) and all(a.end <= b.start for a, b in itertools.pairwise(r.spans))
    assert all(p.spans for p, y in held if y and p.predicted)
    assert hits >= 0.7 * sum(y for _, y in held)  # some of these labels mark texts without any sign


def test_log_probabilities_are_a_distribution():
    rnd = np.random.default_rng(2)
    net = lm.Net(rnd.normal(0, 0.5, len(lm.Net().flat)))
    ctx = rnd.integers(0, lm.SYMBOLS, (2 * lm.WINDOW, 1))
    p = np.exp(net.log_probabilities(np.repeat(ctx, lm.SYMBOLS, axis=1), np.arange(lm.SYMBOLS)))
    assert abs(p.sum() - 1) < 1e-3
    h = np.tanh(sum(net.around[k][ctx[k, 0]] for k in range(2 * lm.WINDOW)) + net.bias)
    for s in (0, 33, 2047):
        z, y = h @ net.by_class[:-1] + net.by_class[-1], h @ net.within[s // lm.PER, :-1] + net.within[s // lm.PER, -1]
        want = z[s // lm.PER] - np.log(np.exp(z).sum()) + y[s % lm.PER] - np.log(np.exp(y).sum())
        assert abs(np.log(p[s]) - want) < 1e-3


def test_training_step_follows_the_gradient():
    rnd = np.random.default_rng(3)
    net, ctx, y = lm.Net(), rnd.integers(0, 50, (2 * lm.WINDOW, 256)), rnd.integers(0, 50, 256)
    before = net.log_probabilities(ctx, y).mean()
    for _ in range(60):
        net.train(ctx, y)
    assert net.log_probabilities(ctx, y).mean() > before + 1


def test_a_step_is_the_gradient_by_differences(monkeypatch):
    rnd = np.random.default_rng(4)
    start = rnd.normal(0, 0.3, len(lm.Net().flat)).astype(np.float32)
    ctx, y = rnd.integers(0, 90, (2 * lm.WINDOW, 24)), rnd.integers(0, lm.SYMBOLS, 24)
    net = lm.Net(start)
    net.train(ctx, y)
    moved = (net.flat - start).astype(float)
    for k in np.r_[np.argsort(-np.abs(moved))[:5], rnd.choice(np.flatnonzero(moved), 20)]:
        up, down = start.copy(), start.copy()
        up[k] += 0.01
        down[k] -= 0.01
        g = -(lm.Net(up).log_probabilities(ctx, y).mean(dtype=float) - lm.Net(down).log_probabilities(ctx, y).mean(dtype=float)) / 0.02
        assert abs(moved[k] + lm.RATE * g / np.sqrt(1e-3 + g * g)) < 5e-3
    assert not moved[lm.SYMBOLS * lm.HIDDEN - lm.HIDDEN : lm.SYMBOLS * lm.HIDDEN].any()  # a symbol that isn't used


def test_a_step_goes_over_its_tokens_at_once(monkeypatch):
    """Whatever the number of classes, the logits of a step are taken through exp() twice: classes, and symbols within them."""
    rnd, calls, exp = np.random.default_rng(5), [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    lm.Net().train(rnd.integers(0, lm.SYMBOLS, (2 * lm.WINDOW, 1024)), rnd.integers(0, lm.SYMBOLS, 1024))
    assert len(calls) == 2


def test_words_of_is_the_pattern():
    latin = "".join(map(chr, range(256)))
    for text in (latin, "".join(f"a{x}b {x}" for x in latin), "ÀÉ_x9 ²³¹¼ \xad\x85\x1c", "İΣ 漢字 é! e\u0301", ""):
        assert lm.words_of(text) == lm.WORD.findall(text.lower())


def test_contexts():
    docs = [np.array([5, 6, 7], np.int32), np.array([8], np.int32)]
    assert lm.contexts(docs).tolist() == [[0, 0, 5, 0], [0, 5, 6, 0], [6, 7, 0, 0], [7, 0, 0, 0]]


def brute_words(texts):
    """word -> (symbol, logarithm of its share), by counting."""
    counts = Counter(w for t in texts for w in lm.WORD.findall((t or "").lower()))
    own = {w: 1 + k for k, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm.OWN])}
    symbol = {w: own.get(w) or 1 + lm.OWN + zlib.crc32(w[-2:].encode()) % lm.ENDINGS for w in counts}
    total = Counter()
    for w, n in counts.items():
        total[symbol[w]] += n
    return {w: (symbol[w], np.log(n / total[symbol[w]])) for w, n in counts.items()}


@pytest.mark.parametrize("own", [lm.OWN, 6])
def test_training_takes_every_token(spark, monkeypatch, own):
    monkeypatch.setattr(lm, "OWN", own)
    monkeypatch.setattr(lm, "SEGMENT_WORDS", 5)
    texts = [f"w{k % 5} v{k % 3}" + (" und mehr" if k % 7 == 0 else "") for k in range(90)]
    lm.small_batches(spark)
    table = lm.numbered(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text", [])
    words = lm.word_table(table)
    want = brute_words(texts)
    assert {r.word: (r.symbol, round(r.log_share, 9)) for r in words.collect()} == {w: (s, round(p, 9)) for w, (s, p) in want.items()}
    path = lm.scratch(spark, "lm")
    lm.write_segments(table, words, path)
    start = lm.Net().flat
    for turn in (0, 1):
        rows = table.where(F.col("turn") == turn).select("segment", "ids").coalesce(1).collect()
        segments = lm.Segments(path)
        docs = [segments.of(r.segment, bytes(r.ids))[0] for r in rows]
        net, ctx, y = lm.Net(start), lm.contexts(docs), np.concatenate(docs)
        order = np.random.default_rng(11).permutation(len(y))
        net.train(ctx[:, order], y[order])
        got = lm.train_on(table.coalesce(1), path, turn, start)
        assert np.allclose(got, net.flat, atol=1e-4)
    assert table.where("kind = 0").count() == len(texts) and {r.turn for r in table.select("turn").distinct().collect()} >= {0, 1}


def test_pseudo_likelihood_tricky(spark):
    rows = lm.pseudo_likelihood(tricky(spark)).collect()
    assert len(rows) == len(TRICKY)
    for r in rows:
        n = len(lm.WORD.findall((r.text or "").lower()))
        assert r.n_tokens == n and (r.mean_log_probability is None) == (n == 0)
        assert r.log_probability <= 0 and (n == 0 or abs(r.mean_log_probability * n - r.log_probability) < 1e-6 * max(1, n))
    assert lm.pseudo_likelihood(tricky(spark).limit(0)).count() == 0


def test_query_op4_is_the_brute_force_sum(spark, monkeypatch):
    """The registered query on the smallest tables, against a softmax written out over symbols and shares."""
    sf = "/root/testdata/sf0.001"
    seen = {}
    train = lm.train_on
    monkeypatch.setattr(lm, "train_on", lambda *a: seen.setdefault(a[2], train(*a)))
    rows = {r.doc_id: r for r in QUERIES["op4_pseudo_likelihood"](spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    words, net = brute_words(texts.values()), lm.Net(seen[1])
    around, bias, by_class, within = (x.astype(float) for x in (net.around, net.bias, net.by_class, net.within))
    for i in sorted(texts, key=lambda i: (len(texts[i]), i))[:40]:
        known = [words[w] for w in lm.WORD.findall(texts[i].lower())]
        s, total = [0, 0, *(k for k, _ in known), 0, 0], 0.0
        for at, (own, share) in enumerate(known):
            h = np.append(np.tanh(around[0][s[at]] + around[1][s[at + 1]] + around[2][s[at + 3]] + around[3][s[at + 4]] + bias), 1)
            z, y = h @ by_class, h @ within[own // lm.PER]
            total += z[own // lm.PER] - np.log(np.exp(z).sum()) + y[own % lm.PER] - np.log(np.exp(y).sum()) + share
        assert rows[i].n_tokens == len(known) and abs(rows[i].log_probability - total) < 1e-3 * max(1, len(known))


def test_query_op4_tells_order(spark, sf):
    """Real texts score better than the same words in another order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    mixed = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.array_join(F.sort_array(F.transform(F.split("text", " "), lambda w, k: F.concat(F.hex(F.xxhash64(w, k)), F.lit("|"), w))), " ").alias("text"))
    mixed = mixed.withColumn("text", F.regexp_replace("text", r"[0-9A-F]+\|", ""))
    scored = lm.pseudo_likelihood(docs.unionByName(mixed)).select((F.col("doc_id") >= 1_000_000).alias("mixed"), "mean_log_probability").groupBy("mixed").agg(F.avg("mean_log_probability").alias("m")).collect()
    means = {r.mixed: r.m for r in scored}
    assert means[False] > means[True]
