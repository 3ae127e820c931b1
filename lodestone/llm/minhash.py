"""Near duplicates by improved consistent weighted sampling (ICWS).

A text is the weighted set of its word shingles; the weight is the count in the text times a smoothed inverse
document frequency between 1 and 2, which tells apart shares of documents from RARE upwards. Frequencies of all
documents are kept in a hashed vector, less what an average slot holds: of shares, a slot's error falls with the
root of the number of documents, so one size of vector serves every number of them. ICWS draws samples that two sets share with a chance equal to their weighted
Jaccard similarity; bands of samples give buckets, and pairs from buckets are verified on whole texts.

Equal texts go as one. In each of its buckets a text is compared with the bucket's first member, its pivot; texts
that are linked, by any bucket, need no more. Buckets with outliers (members in another component than the
pivot) are opened: small ones are finished by comparing outliers with all that are not in their component; large
ones (a group of thousands of copies of a copy, texts that share a long passage) are split by more samples, and
the parts' members are compared with the parts' pivots. What is still apart in a large bucket then is compared
whole, in blocks: every member outside its largest component with every other member, by one product of
matrices a pair of blocks. Rows of one bucket or pivot are always met in parts, as one may hold a third of all. So all pairs of a bucket end in one component or have been compared; the last step's
work grows with a bucket's outliers times its members. Links are made components by contraction of tables."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import c, claim, free_names, partitions, saved, scratch, small_batches
from .tokens import slices

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 9, 3
SAMPLES = BANDS * ROWS
#: Samples that split a large bucket further, per part.
FINER = 4
#: Slots of document frequencies, and those in one row.
SLOTS, CHUNK = 1 << 20, 1 << 15
#: Shingles in a smaller share of documents weigh as much as those in this one.
RARE = 1 / 1024
#: Buckets up to this size are finished at once.
SMALL = 32
#: A table of needed rows up to this many is sent to all executors (16 bytes each).
FEW_ROWS = 2_000_000
#: Members of a block of a large bucket (in the mean), and shared shingles in one product.
BLOCK, COLUMNS = 512, 4096
#: Members compared with one pivot by one task.
A_TASK = 256
REMEMBERED = 200_000

U = np.uint64
_words: dict[str, int] = {}


def word_ids(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, each made once a worker."""
    import xxhash

    known = _words
    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(known) > REMEMBERED:
            known.clear()
        if len(words) > REMEMBERED:
            return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


@lru_cache(1)
def _finder():
    import re

    return re.compile(r"\w+").findall


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct shingles of words in lower case, counts). A text of fewer words is one shingle."""
    found = _finder()(text.lower())
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = word_ids(found)
    n = max(1, len(ids) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(ids))):
        h = h * U(0x9E3779B97F4A7C15) + ids[k : k + n]
    if len(ids) < words:
        h += U(len(ids))
    return np.unique(mixed(h), return_counts=True)


def slot_of(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def document_frequencies(texts: DataFrame, words: int = WORDS) -> np.ndarray:
    """Documents that hold a shingle of each slot, over all documents: a vector of fixed size.

    Tasks send their vectors in chunks, which are added up in two steps as they stream by."""

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        claim(_words)
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, some in slices(batch.column(0)):
                for text in some:
                    h, _ = shingles(text, words)
                    total[np.unique(slot_of(h))] += 1
        salt = TaskContext.get().partitionId() % 32
        used = [k for k in range(SLOTS // CHUNK) if total[k * CHUNK : (k + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()), pa.array([total[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in used], pa.binary())], names=["chunk", "salt", "v"])

    def add(batches):
        import pyarrow as pa

        key, held = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "salt", "v"])
        for batch in batches:
            for k in range(batch.num_rows):
                new, v = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), np.frombuffer(batch.column(2)[k].as_py(), np.int64)
                if new == key:
                    held = held + v
                else:
                    if key is not None:
                        yield row()
                    key, held = new, v
        if key is not None:
            yield row()

    n, kind = partitions(texts.sparkSession), "chunk int, salt int, v binary"
    got = texts.mapInArrow(local, kind)
    got = got.repartition(n, "chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(add, kind)
    got = got.withColumn("salt", F.lit(0)).repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add, kind)
    out = np.zeros(SLOTS, dtype=np.int64)
    for r in got.collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.v, np.int64)
    return out


def idf_vector(df: np.ndarray, documents: int) -> np.ndarray:
    """1 (in all documents) to 2 (in a share of RARE or less), by the logarithm of the share; df less the mean of all slots."""
    own = np.clip(df - df.mean(), 0, documents)
    return (1 + np.minimum(1, np.log((documents + 1) / (own + 1)) / -np.log(RARE))).astype(np.float32)


@lru_cache(1)
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 4096 places, and their logarithms at 65536."""

    def quantiles(n: int) -> np.ndarray:
        u = (np.arange(n) + 0.5) / n
        x = np.sqrt(2 * u) + u  # near enough for Newton's steps
        for _ in range(60):
            x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / (x * np.exp(-x)), x / 4)
        return x

    return quantiles(4096).astype(np.float32), np.log(quantiles(65536)).astype(np.float32)


def icws(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Samples (documents x SAMPLES, 64 bits) of the weighted sets in h, one after another; bounds: where each begins (none empty)."""
    r_of, log_c = _gamma()
    log_w = np.log(weight).astype(np.float32)
    out = np.empty((len(bounds), SAMPLES), np.uint64)
    sizes = np.diff(np.r_[bounds, len(h)])
    for k in range(SAMPLES):
        z = (h ^ U((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) * U(0xFF51AFD7ED558CCD)
        z ^= z >> U(29)
        z *= U(0xC4CEB9FE1A85EC53)
        r = r_of[(z >> U(52)).astype(np.int32)]
        beta = ((z >> U(28)) & U(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        log_a = log_c[((z >> U(12)) & U(0xFFFF)).astype(np.int32)] - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, bounds)
        at = np.flatnonzero(log_a == np.repeat(least, sizes))
        doc = np.searchsorted(bounds, at, side="right") - 1
        first = np.r_[True, doc[1:] != doc[:-1]]
        at = at[first]
        out[:, k] = mixed(h[at] * U(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(np.uint64) + U(k))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights; a and b: (sorted hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 0.0


def _samples(base: DataFrame, idf, words: int) -> DataFrame:
    """rid, k1, k2 and the samples of each text (null for a text without words)."""
    fields = "rid long, k1 long, k2 long, samples array<long>"

    def run(batches):
        import pyarrow as pa

        claim(_words)
        weight_of = idf.value
        for batch in batches:
            for at, texts in slices(batch.column(3), 128):
                hs, ws, bounds, rows, n = [], [], [], [], 0
                for k, text in enumerate(texts):
                    h, counts = shingles(text, words)
                    if len(h):
                        hs.append(h)
                        ws.append(weight_of[slot_of(h)] * counts)
                        bounds.append(n)
                        rows.append(k)
                        n += len(h)
                got = [None] * len(texts)
                if rows:
                    for k, s in zip(rows, icws(np.concatenate(hs), np.concatenate(ws), np.array(bounds)).view(np.int64).tolist()):
                        got[k] = s
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, len(texts)) for i in range(3)), pa.array(got, pa.list_(pa.int64()))], names=["rid", "k1", "k2", "samples"])

    return base.select("rid", "k1", "k2", "text").mapInArrow(run, fields)


def _verified(pairs: DataFrame, base: DataFrame, idf, similarity: float, words: int, label: str) -> DataFrame:
    """pairs (p, m) whose texts' weighted Jaccard similarity is at least the given one, with it."""
    pairs = saved(pairs, f"{label}-pairs")
    need = pairs.select(F.col("p").alias("rid")).union(pairs.select(F.col("m").alias("rid"))).distinct()
    need = saved(need, f"{label}-need")
    texts = base.select("rid", "text").join(F.broadcast(need) if need.count() <= FEW_ROWS else need, "rid", "left_semi")
    dealt = _sized(pairs, "p", "m").select("p", "m", F.pmod(F.hash("m"), F.ceil(F.col("n") / A_TASK).cast("int")).alias("salt"))
    members = dealt.join(texts.withColumnRenamed("rid", "m"), "m").select("p", "salt", "m", "text")
    pivots = dealt.select("p", "salt").distinct().join(texts.withColumnRenamed("rid", "p"), "p").select("p", "salt", F.lit(None).cast("long").alias("m"), "text")
    rows = members.unionByName(pivots).repartition(partitions(base.sparkSession), "p", "salt").sortWithinPartitions("p", "salt", F.col("m").asc_nulls_first())

    def run(batches):
        import pyarrow as pa

        claim(_words)
        weight_of = idf.value

        def vector(text):
            h, counts = shingles(text, words)
            return h, weight_of[slot_of(h)] * counts

        pivot = None
        for batch in batches:
            for at, texts in slices(batch.column(3)):
                ps, ms = batch.column(0).slice(at, len(texts)).to_pylist(), batch.column(2).slice(at, len(texts)).to_pylist()
                out = []
                for p, m, text in zip(ps, ms, texts):
                    if m is None:
                        pivot = vector(text)
                        continue
                    s = weighted_jaccard(pivot, vector(text))
                    if s >= similarity:
                        out.append((p, m, s))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["p", "m", "similarity"])

    return saved(rows.mapInArrow(run, "p long, m long, similarity double"), f"{label}-links")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node linked to it, over any number of links) for each node of links (p, m).

    Each turn maps every node to its smallest neighbour, jumps once further along these pointers, and contracts
    the links; what is left to link shrinks with every turn, and so does the work."""
    path, turn, labels = scratch(links.sparkSession, "labels"), 0, None
    edges = saved(links.select(F.least("p", "m").alias("a"), F.greatest("p", "m").alias("b")).where("a < b").distinct(), "labels", f"{path}/edges-0")
    while True:
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("near")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("near")))
        low = both.groupBy("node").agg(F.min("near").alias("low"))
        if turn == 0 and edges.isEmpty():
            return low.select("node", F.col("low").alias("comp"))
        low = saved(low, "labels", f"{path}/low-{turn}")
        further = low.select(F.col("node").alias("at"), F.col("low").alias("far"))
        jumped = saved(low.join(further, low.low == further.at).select("node", F.col("far").alias("to")), "labels", f"{path}/jumped-{turn}")
        to = jumped.select(F.col("node").alias("n"), "to")
        labels = jumped.select("node", F.col("to").alias("comp")) if labels is None else labels.join(to, F.col("comp") == F.col("n"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = saved(labels, "labels", f"{path}/labels-{turn}")
        # A link of two nodes is one of their targets; a target that points further is linked to where it points.
        mapped = edges.join(to, edges.a == F.col("n")).select(F.col("to").alias("x"), "b").join(to, F.col("b") == F.col("n")).select("x", F.col("to").alias("y"))
        onward = jumped.select("to").distinct().join(jumped.select("node", F.col("to").alias("next")), F.col("to") == F.col("node")).select(F.col("to").alias("x"), F.col("next").alias("y"))
        left = mapped.union(onward).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        turn += 1
        edges = saved(left, "labels", f"{path}/edges-{turn}")
        if edges.isEmpty():
            return labels


def _with_comp(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _sized(rows: DataFrame, key: str, member: str) -> DataFrame:
    """rows with n, the number of rows of their key, and least, its smallest member. A key's rows are counted and
    given these in as many parts as there are partitions."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(member), F.lit(partitions(rows.sparkSession))))
    parts = dealt.groupBy(key, "part").agg(F.min(member).alias("least"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    parts = parts.select(key, "part", F.min("least").over(w).alias("least"), F.sum("n").over(w).alias("n"))
    return dealt.join(parts, [key, "part"]).drop("part")


def _members(rows: DataFrame) -> DataFrame:
    """The rows whose bucket has another one, with its first node p and its size n."""
    return _sized(rows, "bucket", "node").where("n > 1").select("node", "bucket", F.col("least").alias("p"), "n")


def _told(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (of _members) joined with buckets, a row for each bucket and its size n: large ones in parts."""
    parts = F.ceil(F.col("n") / A_TASK)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), parts))
    return dealt.join(buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), ["bucket", "n", "part"]).drop("part")


def _finer():
    """Buckets within a bucket, as an array: one for each of several choices of FINER samples across the bands."""
    parts = [range(k, SAMPLES, SAMPLES // FINER)[:FINER] for k in range(SAMPLES // FINER)]
    return F.array(*[F.xxhash64("bucket", F.lit(k), *[F.element_at("samples", i + 1) for i in part]) for k, part in enumerate(parts)])


def _star(rows: DataFrame) -> DataFrame:
    """Pairs of each bucket's first node with its others."""
    return rows.where("node > p").select("p", F.col("node").alias("m")).distinct()


def _outliers(rows: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all members, outliers) of the buckets with nodes in another component than their first node's; with comp and pivot_comp."""
    placed = saved(_with_comp(rows.where("n > 2"), comps), "placed")
    placed = saved(_told(placed, placed.where("node = p").select("bucket", "n", F.col("comp").alias("pivot_comp"))), "placed")
    outliers = placed.where("comp != pivot_comp")
    return saved(_told(placed, outliers.select("bucket", "n").distinct()), "open"), outliers


def _cross(members: DataFrame, outliers: DataFrame) -> DataFrame:
    """Outliers against all of their bucket that are not in their component, but for pivots, which were compared."""
    o = outliers.select("bucket", F.col("node").alias("a"), F.col("comp").alias("ca"), "pivot_comp")
    m = members.where("node != p").select("bucket", F.col("node").alias("b"), F.col("comp").alias("cb"))
    met = o.join(m, "bucket").where("ca != cb AND (cb = pivot_comp OR a < b)")
    return met.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("m")).distinct()


def linked_across(found: list[tuple], similarity: float) -> list[tuple]:
    """Links (p, m, similarity) that join the components of found: rows of (node, comp, on the left, hashes, counts,
    weights of one count). Left rows are compared with all; one link is enough between components."""
    # The k-th occurrence of a shingle is a feature of its own, so that smaller counts are sums over shared features.
    ids, weights, docs, total = [], [], [], np.zeros(len(found))
    for k, (_, _, _, h, counts, w) in enumerate(found):
        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids.append(np.repeat(h, counts) + turn.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        weights.append(np.repeat(w, counts))
        docs.append(np.full(len(turn), k))
        total[k] = (w.astype(float) * counts).sum()
    ids, weights, docs = np.concatenate(ids), np.concatenate(weights), np.concatenate(docs)
    order = np.argsort(ids)
    ids, weights, docs = ids[order], weights[order], docs[order]
    col = np.cumsum(np.r_[False, ids[1:] != ids[:-1]])
    shared = (np.bincount(col) > 1)[col]
    weights, docs = weights[shared], docs[shared]
    col = np.unique(col[shared], return_inverse=True)[1]
    left = np.flatnonzero([r[2] for r in found])
    both = np.zeros((len(left), len(found)), np.float32)
    for at in range(0, int(col.max()) + 1 if len(col) else 0, COLUMNS):
        a, b = np.searchsorted(col, (at, at + COLUMNS))
        x = np.zeros((len(found), COLUMNS), np.float32)
        w = np.zeros(COLUMNS, np.float32)
        x[docs[a:b], col[a:b] - at] = 1
        w[col[a:b] - at] = weights[a:b]
        both += (x[left] * w) @ x.T
    comps = np.array([r[1] for r in found])
    # A little below the bound by these rounded sums; the exact comparison decides.
    near = both >= (similarity - 1e-3) * (total[left][:, None] + total[None, :] - both)
    near &= comps[left][:, None] != comps[None, :]
    top: dict[int, int] = {}

    def root(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(near))):
        a, b = found[left[i]], found[j]
        ca, cb = root(a[1]), root(b[1])
        if ca != cb and (s := weighted_jaccard((a[3], a[5] * a[4]), (b[3], b[5] * b[4]))) >= similarity:
            top[ca] = cb
            out.append((min(a[0], b[0]), max(a[0], b[0]), s))
    return out


def _crossed(rows: DataFrame, comps: DataFrame, base: DataFrame, idf, similarity: float, words: int) -> DataFrame:
    """Links between components within the buckets of more than SMALL nodes: all members outside a bucket's largest
    component are compared with all others, in blocks that hash values of the nodes choose."""
    placed = saved(_with_comp(rows.where(F.col("n") > SMALL), comps), "placed")
    kinds = placed.groupBy("bucket", "n", "comp").agg(F.count(F.lit(1)).alias("held"))
    size = kinds.groupBy("bucket", "n").agg(F.max(F.struct("held", "comp")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    lefts, rights = F.ceil((F.col("n") - F.col("main.held")) / BLOCK), F.ceil(F.col("main.held") / BLOCK)
    size = size.select("bucket", "n", F.col("main.comp").alias("main"), lefts.alias("lefts"), rights.alias("rights"))
    left = F.col("comp") != F.col("main")
    block = F.when(left, F.pmod(F.xxhash64("node"), "lefts")).otherwise(F.col("lefts") + F.pmod(F.xxhash64("node"), "rights"))
    dealt = _told(placed, size).select("bucket", "node", "comp", "lefts", left.alias("left"), block.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.when(left, F.col("lefts") + F.col("rights")).otherwise(F.col("lefts")) - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", (F.col("left") & (F.col("own") <= F.col("other"))).alias("left"))
    dealt = saved(dealt, "blocks")
    need = saved(dealt.select(F.col("node").alias("rid")).distinct(), "blocks-need")
    texts = base.select("rid", "text").join(F.broadcast(need) if need.count() <= FEW_ROWS else need, "rid", "left_semi")
    full = dealt.join(texts, dealt.node == texts.rid).select("bucket", "i", "j", "node", "comp", "left", "text")
    full = full.repartition(partitions(base.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        import pyarrow as pa

        claim(_words)
        weight_of = idf.value
        key, found = None, []
        result = lambda out: pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], names=["p", "m", "similarity"])
        for batch in batches:
            for at, texts in slices(batch.column(6)):
                columns = [batch.column(k).slice(at, len(texts)).to_pylist() for k in range(6)]
                for bucket, i, j, node, comp, left, text in zip(*columns, texts):
                    if key != (bucket, i, j):
                        if found:
                            yield result(linked_across(found, similarity))
                        key, found = (bucket, i, j), []
                    h, counts = shingles(text, words)
                    found.append((node, comp, left, h, counts, weight_of[slot_of(h)]))
        if found:
            yield result(linked_across(found, similarity))

    return saved(full.mapInArrow(run, "p long, m long, similarity double").distinct(), "crossed-links")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """docs' columns and class_id, class_size, kept: one row for each of docs.

    Texts are linked when their weighted Jaccard similarity is at least `similarity`, and when equal; a class is
    a set of linked texts; class_id is its smallest id (null if all are), and that row is kept (of several, one).
    A null text counts as empty; empty texts and texts without words are only linked to equal ones. An empty
    table gives an empty result. Columns of docs that have an output's name are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    out = ["class_id", "class_size", "kept"]
    rid, text = free_names(docs, "_rid", "_text")
    t = F.coalesce(c(text_col), F.lit(""))
    table = saved(docs.withColumn(rid, F.monotonically_increasing_id()), "docs")
    base = table.select(F.col(rid).alias("rid"), c(id_col).alias("id"), t.alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64("text", F.lit("second")))
    total = base.count()
    idf = spark.sparkContext.broadcast(idf_vector(document_frequencies(base.select("text"), words), total))
    sampled = saved(_samples(base, idf, words), "samples")

    # Equal texts are one node.
    nodes = sampled.groupBy("k1", "k2").agg(F.min("rid").alias("node"))
    members = saved(sampled.join(nodes, ["k1", "k2"]).select("rid", "node", F.when(F.col("rid") == F.col("node"), F.col("samples")).alias("samples")), "members")
    own = members.where("rid = node AND samples IS NOT NULL").select("node", "samples")

    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice("samples", b * ROWS + 1, ROWS))))
    rows = saved(_members(own.select("node", band.alias("b", "bucket")).select("node", "bucket")), "buckets")
    links = _verified(_star(rows), base, idf, similarity, words, "first")
    comps = components(links)

    # Small buckets are finished; large ones are split by more samples, and then what is still apart in them is compared whole.
    open_members, outliers = _outliers(rows, comps)
    large = open_members.where(F.col("n") > SMALL).select("bucket", "node")
    finer = saved(_members(large.join(own, "node").select("node", F.explode(_finer()).alias("bucket"))), "finer")
    pairs = _cross(open_members.where(F.col("n") <= SMALL), outliers.where(F.col("n") <= SMALL)).union(_star(finer)).distinct()
    second = _verified(pairs, base, idf, similarity, words, "second")
    links = links.union(second)
    if not second.isEmpty():
        comps = components(links)
    third = _crossed(rows, comps, base, idf, similarity, words)
    if not third.isEmpty():
        comps = components(links.union(third))

    placed = _with_comp(members.select("rid", "node"), comps).join(base.select("rid", "id"), "rid")
    classes = placed.groupBy("comp").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("best"))
    decided = placed.join(classes, "comp").select(F.col("rid").alias(rid), "class_id", "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"))
    rest = [c(x) for x in docs.columns if x.lower() not in out]
    return table.select(*rest, rid).join(decided, rid).select(*rest, "class_id", "class_size", "kept")


def op8_minhash_icws(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_size", "kept")
