import struct
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup as ed
from lodestone.llm import feistel_shards as fs
from lodestone.llm import imatch as im
from lodestone.llm.queries import QUERIES

from .helpers import TRICKY, tricky


def normal(t):
    return "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in (t or ""))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("share", [4, 1 / 8])
def test_exact_dedup_tricky(spark, keep, share, monkeypatch):
    monkeypatch.setattr(ed, "SHARE", share)  # 1/8: every text is rare; 4: those with copies are salted
    rows = ed.exact_dedup(tricky(spark), keep=keep).collect()
    assert len(rows) == len(TRICKY)
    groups = defaultdict(list)
    for i, t in TRICKY:
        groups[normal(t)].append(i)
    kept = Counter()
    for r in rows:
        own = groups[normal(r.text)]
        ids = [i for i in own if i is not None]
        assert r.keep_id == ((min if keep == "smallest" else max)(ids) if ids else None)
        assert r.group_size == len(own)
        assert r["a.b"] == "x" and r["_norm"] == "x"
        if r.kept:
            kept[normal(r.text)] += 1
            assert r.doc_id == r.keep_id
    assert all(kept[g] == 1 for g in groups)


def test_exact_dedup_hot_group(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Hot text', concat('text ', id)) AS text")
    out = ed.exact_dedup(df)
    assert out.where("kept").count() == 2001
    assert out.where("text = 'Hot text'").select("keep_id", "group_size").distinct().collect() == [(0, 1000)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("Exchange hashpartitioning") == 1  # the totals of salted texts; runs need none


def test_exact_dedup_empty(spark):
    assert ed.exact_dedup(tricky(spark).limit(0)).count() == 0


def test_query_op2(spark, tiny):
    rows = QUERIES["op2_exact_dedup"](spark, tiny).collect()
    docs = {r.doc_id: normal(r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    groups = defaultdict(list)
    for i, t in docs.items():
        groups[t].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows} == {(i, max(groups[t]), len(groups[t]), i == max(groups[t])) for i, t in docs.items()}


def brute_position(x, n, seed):
    left, right = fs.widths(n)
    hash64 = lambda v, k: xxhash.xxh64_intdigest(struct.pack("<q", k), seed=xxhash.xxh64_intdigest(struct.pack("<q", v), seed=42))
    while True:
        a, b = x >> right, x & ((1 << right) - 1)
        for i, k in enumerate(fs.round_keys(seed)):
            a, b = b, a ^ (hash64(b, k) & ((1 << (left if i % 2 == 0 else right)) - 1))
        x = a << right | b
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", fs.permuted("id", n, 99).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(got[i] == brute_position(i, n, 99) for i in range(0, n, max(1, n // 50)))


def test_shards_tricky(spark):
    out = fs.feistel_shards(tricky(spark), 4, ["doc_id"]).collect()
    assert sorted(r.row_number for r in out) == list(range(len(TRICKY)))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.row_number)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    again = fs.feistel_shards(tricky(spark).repartition(5), 4, ["doc_id"]).select("doc_id", "text", "shard", "slot")
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in out)
    assert fs.feistel_shards(tricky(spark).limit(0), 4, ["doc_id"]).count() == 0


def test_query_op10(spark, tiny):
    rows = QUERIES["op10_feistel_shards"](spark, tiny).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    order = {i: k for k, i in enumerate(sorted(docs))}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        at = brute_position(order[r.doc_id], len(docs), 2024)
        assert (r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", at % 40, at // 40, None)


# -- fingerprints by the definitions, without Spark -------------------------------------------------------------

M32, M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def rotated(x, n):
    return ((x << n) | (x >> (32 - n))) & M32


def mix(h, k):
    k = (rotated(k * 0xCC9E2D51 & M32, 15) * 0x1B873593) & M32
    return (rotated(h ^ k, 13) * 5 + 0xE6546B64) & M32


def finish(h, n):
    h ^= n
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & M32
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & M32
    return h ^ (h >> 16)


def murmur_long(x, seed):
    return finish(mix(mix(seed, x & M32), (x >> 32) & M32), 8)


def murmur_text(text, seed=42):
    raw, h = text.encode(), seed
    for k in range(0, len(raw) // 4 * 4, 4):
        h = mix(h, int.from_bytes(raw[k : k + 4], "little"))
    for b in raw[len(raw) // 4 * 4 :]:
        h = mix(h, (b - 256 if b > 127 else b) & M32)
    return finish(h, len(raw))


def brute_words(text):
    return sorted({w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w})


def brute_print(text, lexicon):
    words = brute_words(text)
    terms = []
    for w in [w for w in words if w in lexicon] or words:
        h = xxhash.xxh64_intdigest(b"lexicon", xxhash.xxh64_intdigest(w.encode(), 42))
        bits, at = set(), 0
        for level, cells in enumerate(im.CELLS):
            cell = (h >> at) & (cells - 1)
            if cell < im.SUBSETS:
                bits.add(cell + im.SUBSETS * level)
            at += cells.bit_length() - 1
        terms.append((h, bits))

    def hashed(some):
        seed = 42
        for h, bits in some:
            seed = murmur_long(sum(1 << b for b in bits), murmur_long(h, seed))
        return seed

    return [hashed(terms) if terms else murmur_text(text.lower())] + [hashed([t for t in terms if k in t[1]]) for k in range(im.SUBSETS * len(im.CELLS))]


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    pairs = [None if x == y == im.EMPTY else x == y for x, y in zip(a[1:], b[1:])]
    for level in reversed(range(len(im.CELLS))):
        own = [p for p in pairs[im.SUBSETS * level : im.SUBSETS * (level + 1)] if p is not None]
        if len(own) >= im.LEAST_INFORMED:
            return sum(own) / len(own)
    own = [p for p in pairs if p is not None]
    return sum(own) / len(own) if own else 0.0


def test_query_op3_is_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for t in texts.values() for w in brute_words(t))
    lexicon = {w for w, n in counts.items() if max(2.0, 5e-4 * len(texts)) <= n <= max(2.0, 0.05 * len(texts))}
    own = {i: brute_print(t, lexicon) for i, t in texts.items()}
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op3_imatch"](spark, sf).collect()}
    assert rows.keys() == texts.keys()
    text_of = lambda prints: "".join(f"{x:08X}" for x in prints)
    for k, i in enumerate(order):
        following = order[(k + 1) % len(order)]
        t, n = texts[i], len(texts[i]) // 3
        edited = brute_print(t[: len(t) - n] + texts[following][:n], lexicon)
        r = rows[i]
        assert r.fingerprint == text_of(own[i]) and r.edited_fingerprint == text_of(edited)
        assert abs(r.near_edited - brute_likeness(own[i], edited)) < 1e-12 and abs(r.near_next - brute_likeness(own[i], own[following])) < 1e-12


def test_neighbours_bear_any_names(spark):
    rows = [(k, f"t{k}", "x", "y") for k in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, head_id string, ghost_bucket string").withColumn("_head", F.lit(1)).withColumn("_places", F.lit(2))
    got = {r.id: r.next_text for r in im.with_next(df, "id", ["text"]).collect()}
    assert got == {k: f"t{(k - 1) % 50}" for k in range(50)}
    with pytest.raises(TypeError):
        im.with_next(df.withColumn("id", F.col("id").cast("string")), "id", ["text"])


def test_neighbours_in_many_buckets(spark, monkeypatch):
    """One id on half of the rows, null ids, buckets of a few rows: every row has one next row, in one descending circle."""
    monkeypatch.setattr(im, "BUCKET_BYTES", 20_000)
    ids = [None if k % 50 == 0 else 7 if k % 2 else k * 37 % 501 - 250 for k in range(2000)]
    df = spark.createDataFrame([(i, f"t{k}" + "x" * (k % 61)) for k, i in enumerate(ids)], "id long, text string").repartition(5)
    rows = im.with_next(df, "id", ["text"]).collect()
    following, of = {r.text: r.next_text for r in rows}, {r.text: r.id for r in rows}
    assert len(rows) == len(following) == len(set(following.values())) == 2000
    at, seen = "t0", []
    for _ in range(2000):
        seen.append(-1000 if of[at] is None else of[at])
        at = following[at]
    assert at == "t0" and sum(a < b for a, b in zip(seen, seen[1:] + seen[:1])) == 1


def test_bucket_starts_by_bytes(spark, monkeypatch):
    """No bucket holds more than its share and one row beyond; long rows stand alone."""
    monkeypatch.setattr(im, "BUCKET_BYTES", 1000)
    sizes = [5000 if k % 40 == 0 else 100 for k in range(400)]
    df = spark.createDataFrame([(k, 0, s) for k, s in enumerate(sizes)], "x long, y long, s long").repartition(3)
    found, n = im.bucket_starts(df, F.col("s"), ["x", "y"], 1)
    starts = [r.a for r in found.first().starts]
    assert n == -(-sum(sizes) // 1000) and starts[0] == 0 and starts == sorted(set(starts)) and len(starts) <= n
    for a, b in zip(starts, starts[1:] + [400]):
        assert sum(sizes[a:b]) <= 1000 + max(sizes[a:b])
    assert im.bucket_starts(df.limit(0), F.col("s"), ["x", "y"], 1)[0].first().starts == []
