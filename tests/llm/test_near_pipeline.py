import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import imatch as im
from lodestone.llm import minhash as mh
from lodestone.llm.queries import QUERIES

from .helpers import TRICKY, tricky


def brute_classes(rows, similarity=0.8):
    """Components of the texts' graph by all pairs: {row number: row numbers}. Uses the operator's weights."""
    texts = [t or "" for _, t in rows]
    df = np.zeros(mh.SLOTS, dtype=np.int64)
    sets = [mh.shingles(t) for t in texts]
    for h, _ in sets:
        df[np.unique(mh.slot_of(h))] += 1
    idf = mh.idf_vector(df, len(texts))
    vectors = [(h, idf[mh.slot_of(h)] * n) for h, n in sets]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (h, _) in enumerate(vectors):
        for x in h.tolist():
            where[x].append(i)
    near = {(i, j) for own in where.values() if len(own) < 400 for i in own for j in own if i < j}
    sims = {}
    for i, j in near:
        sims[i, j] = mh.weighted_jaccard(vectors[i], vectors[j])
        if sims[i, j] >= similarity:
            parent[top(i)] = top(j)
    first = {}
    for i, t in enumerate(texts):
        if t in first:
            parent[top(i)] = top(first[t])
        first.setdefault(t, i)
    classes = defaultdict(set)
    for i in range(len(texts)):
        classes[top(i)].add(i)
    return {i: frozenset(own) for own in classes.values() for i in own}


def test_weighted_jaccard():
    a, b = (np.array([1, 2, 3], np.uint64), np.array([1.0, 2.0, 3.0])), (np.array([2, 3, 4], np.uint64), np.array([1.0, 4.0, 1.0]))
    assert mh.weighted_jaccard(a, b) == pytest.approx((1 + 3) / (1 + 2 + 4 + 1))
    assert mh.weighted_jaccard(a, a) == 1.0


def test_samples_agree_as_often_as_sets_are_similar():
    rnd = np.random.default_rng(4)
    h = np.sort(rnd.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64))
    hits, want = [], []
    for k in range(60):
        ha, hb = h[: 300 + k], h[100:]
        wa, wb = rnd.uniform(1, 2, len(h)), rnd.uniform(1, 2, len(h))
        wb = np.where(rnd.random(len(h)) < 0.7, wa, wb)
        x, y = (ha, wa[: 300 + k].astype(np.float32)), (hb, wb[100:].astype(np.float32))
        a, b = (mh.icws(mh.mixed(v[0] + np.uint64(k)), v[1], np.array([0])) for v in (x, y))
        hits.append((a == b).mean())
        want.append(mh.weighted_jaccard(x, y))
    assert abs(np.mean(hits) - np.mean(want)) < 0.03


def test_near_classes_tricky(spark):
    rows = mh.near_classes(tricky(spark)).collect()
    assert len(rows) == len(TRICKY)
    classes = brute_classes(TRICKY)
    ids = {r.doc_id: r for r in rows if r.doc_id is not None}
    for own in set(classes.values()):
        members = [TRICKY[i][0] for i in own]
        known = [i for i in members if i is not None]
        for i in known:
            assert ids[i].class_id == min(known) and ids[i].class_size == len(members)
    kept = defaultdict(int)
    for r in rows:
        kept[r.class_id] += r.kept
    assert sum(r.kept for r in rows) == len(set(classes.values()))
    assert mh.near_classes(tricky(spark).limit(0)).count() == 0


def corpus(seed=5):
    """Groups of near copies around hubs, a passage that many share, and texts of their own."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows, k = [], 0
    for g in range(12):
        base = [word() for _ in range(rnd.choice((30, 120, 300)))]
        for c in range(rnd.choice((2, 3, 40))):
            own = list(base)
            for _ in range(len(own) // 100 if c else 0):
                own[rnd.randrange(len(own))] = word()
            rows.append((k, " ".join(own)))
            k += 1
    for _ in range(150):
        own = [word() for _ in range(rnd.choice((40, 100)))]
        at = rnd.randrange(len(own))
        rows.append((k, " ".join(own[:at] + passage + own[at:])))
        k += 1
    return rows


@pytest.mark.parametrize("small", [2, 32])
def test_near_classes_against_all_pairs(spark, small, monkeypatch):
    monkeypatch.setattr(mh, "SMALL", small)
    rows = corpus()
    want = brute_classes(rows)
    got = defaultdict(set)
    for r in mh.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == set(want.values())


def test_links_of_large_buckets_are_all_found(spark, monkeypatch):
    """Copies that are as near to each other as to their pivot: most links are between outliers of large buckets."""
    monkeypatch.setattr(mh, "SMALL", 2)
    monkeypatch.setattr(mh, "BLOCK", 7, raising=False)
    monkeypatch.setattr(mh, "FINER", mh.SAMPLES)  # no part of a bucket holds texts that aren't nearly equal
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(250)]
        for _ in range(60):
            own = list(base)
            for at in rnd.sample(range(250), 3):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    want = brute_classes(rows)
    got = defaultdict(set)
    for r in mh.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.class_id].add(r.doc_id)
    assert {frozenset(v) for v in got.values()} == set(want.values())


def test_query_op8(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = brute_classes(rows)
    wrong = sum(r.class_id != min(rows[i][0] for i in want[r.doc_id]) for r in QUERIES["op8_minhash_icws"](spark, sf).collect())
    assert wrong <= 0.005 * len(rows)


def test_weights_follow_shares_of_documents_at_every_size():
    for n in (20_000, 2_000_000, 200_000_000):
        df = np.random.default_rng(1).poisson(3e-4 * n, mh.SLOTS)
        df[:3] += np.array([n, n // 64, n // 4])
        idf = mh.idf_vector(df, n)
        assert idf[:3] == pytest.approx([1, 1.6, 1.2], abs=0.01)
        assert idf[3:].min() > 1.97 and idf.max() == 2


def test_members_of_hot_buckets_are_told_of_them(spark):
    rows = spark.range(3001).selectExpr("id AS node", "CASE WHEN id < 2000 THEN 1 WHEN id < 3000 THEN id DIV 2 ELSE -1 END AS bucket")
    got = mh._members(rows).collect()
    sizes = {r.bucket: (r.p, r.n) for r in got}
    assert len(got) == 3000 and sizes[1] == (0, 2000) and sizes[1000] == (2000, 2) and -1 not in sizes
    members = mh._members(rows)
    assert mh._told(members, members.where("node = p").selectExpr("bucket", "n", "node AS told")).where("told != p").count() == 0
    assert mh._told(members, members.where("node = p").select("bucket", "n")).count() == 3000


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (50, 102)], "p long, m long")
    got = {r.node: r.comp for r in mh.components(links).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {k: 50 for k in (50, 100, 101, 102)}
    assert mh.components(links.limit(0)).count() == 0


def test_imatch_tricky(spark):
    out, table, joined = im.imatch(tricky(spark))
    rows = out.collect()
    assert len(rows) == len(TRICKY) and not joined
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.text or ""].add(tuple(r.fingerprint))
    assert all(len(v) == 1 for v in by_text.values())
    assert im.imatch(tricky(spark).limit(0))[0].count() == 0


def test_imatch_joined_lexicon_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 150")
    a = {r.doc_id: r.fingerprint for r in im.imatch(docs)[0].collect()}
    monkeypatch.setattr(im, "MOST_WORDS", 0)
    out, _, joined = im.imatch(docs)
    assert joined and {r.doc_id: r.fingerprint for r in out.collect()} == a


def test_with_next(spark):
    df = spark.createDataFrame([(k * 3 % 101, f"t{k * 3 % 101}") for k in range(101)] + [(None, "none")], "id long, t string").repartition(5)
    got = {r.id: r.next_t for r in im.with_next(df, "id", ["t"]).collect()}
    assert got == {k: f"t{k - 1}" for k in range(1, 101)} | {0: "none", None: "t100"}
    assert im.with_next(df.limit(0), "id", ["t"]).count() == 0
    one = spark.createDataFrame([(4, "t4")], "id long, t string")
    assert [r.next_t for r in im.with_next(one, "id", ["t"]).collect()] == ["t4"]


def test_query_op3(spark, sf):
    import hashlib

    rows = {r.doc_id: r for r in QUERIES["op3_imatch"](spark, sf).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    prints = {}
    for k, i in enumerate(order):
        text, nxt, r = docs[i], docs[order[(k + 1) % len(order)]], rows[i]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if nxt == text:
            assert r.near_next == 1
        if r.edited_fingerprint == r.fingerprint:
            assert r.near_edited == 1
    assert np.mean([r.near_edited for r in rows.values()]) > 10 * np.mean([r.near_next for r in rows.values()])


def test_pipeline_stages(spark, sf):
    """Each stage's rows against the operators' brute force on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert all(before[i] == r for i, r in after.items())
        if name == "toxicity":
            gone = set(before) - set(after)
            assert not any(labels.get(i) == 0 for i in gone) and sum(labels.get(i) == 1 for i in gone) >= 0.7 * sum(labels.values())
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(before[i].text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), i)
            assert set(after) == set(first.values())
        else:
            rows = [(i, before[i].text) for i in sorted(before)]
            want = {min(rows[k][0] for k in own) for own in brute_classes(rows).values()}
            assert len(set(after) ^ want) <= 0.005 * len(rows)
        docs, before = out, after
    from .test_tokens_packing import FILES, check_packing

    packed = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in corpus_pipeline.STAGES[3][1](spark, docs, sf).collect()]
    check_packing(packed, [(i, r.text) for i, r in before.items()], 2048, FILES[0])


def test_pipeline_stages_tricky(spark, sf):
    docs = tricky(spark).withColumn("toxic", F.lit("mine")).withColumn("keep_id", F.lit("mine"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        got = out.collect()
        assert all(r["score"] == r["kept"] == r["class_id"] == r["a.b"] == "x" and r["toxic"] == r["keep_id"] == "mine" and r["m"] == {"a": 1} for r in got)
        left = [(r.doc_id, r.text) for r in got]
        if name == "toxicity":
            assert sorted(map(str, left)) == sorted(map(str, rows))
        elif name == "exact_dedup":
            assert len(left) == len({(t or "").lower() for _, t in rows})
        assert stage(spark, docs.limit(0), sf).count() == 0
        docs = spark.createDataFrame(got, docs.schema)
    assert len(corpus_pipeline.STAGES[3][1](spark, docs, sf).select("doc_id").collect()) >= len(left)
