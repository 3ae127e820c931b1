"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents only, so tokens are labelled first: in a document marked toxic, a token is toxic
if its word, or its beginning or end, occurs in toxic documents far more than in others. The field (states
"other" and "toxic") learns weights for these features and for its transitions on whole token sequences.
Forward and backward passes give each token's marginal; a logistic layer over their sum, maximum and count
gives the document's score; runs of toxic tokens give character offsets."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, claim, small_batches

#: The bound of the training sample: documents of each label, and characters of all.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 900, 1300, 6_000_000
HASHED = 1 << 18
#: A feature marks tokens if at least so many toxic documents, and this share of them, have it (copies of one
#: document share rare words), at odds of at least e to this power.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 4, 0.02, 3.5
STEPS, RATE, DECAY = 60, 0.25, 1e-6
LANES = 256
BATCH_TOKENS = 1 << 16
REMEMBERED = 150_000

WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """Of a word in lower case: itself, its beginnings and its ends."""
    out = ["=" + word]
    if len(word) > 3:
        out += [f"^{word[:n]}" for n in (3, 4, 5) if len(word) > n] + [f"{word[-n:]}$" for n in (3, 4) if len(word) > n]
    return out


def hashed(word: str) -> list[int]:
    import xxhash

    return [xxhash.xxh32_intdigest(f) % HASHED for f in features(word)]


def lanes_of(emission: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """Matrices (from, to) of each token, as four arrays of steps x lanes. trans: start other, start toxic, then
    other-other, other-toxic, toxic-other, toxic-toxic, all positive; first: where documents begin."""
    n = len(emission)
    steps = max(1, -(-n // LANES))
    e = np.ones(steps * LANES)
    e[:n] = np.exp(np.clip(emission, -30, 30))
    begin = np.ones(steps * LANES, dtype=bool)
    begin[:n] = first
    m = [np.where(begin, trans[0], trans[2]), np.where(begin, trans[1], trans[3]) * e, np.where(begin, trans[0], trans[4]), np.where(begin, trans[1], trans[5]) * e]
    return [np.ascontiguousarray(x.reshape(LANES, steps).T) for x in m], steps


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, edges: bool = False):
    """The probability of "toxic" for each token, and with edges the expected numbers of the transitions.

    All documents of a batch are one sequence that starts anew at each first token. It is laid out in lanes:
    products of matrices over each lane give the messages between lanes, and then all lanes run at once."""
    (m00, m01, m10, m11), steps = lanes_of(emission, first, trans)
    p00, p01, p10, p11 = np.ones(LANES), np.zeros(LANES), np.zeros(LANES), np.ones(LANES)
    for s in range(steps):
        a, b, d, e = m00[s], m01[s], m10[s], m11[s]
        p00, p01, p10, p11 = p00 * a + p01 * d, p00 * b + p01 * e, p10 * a + p11 * d, p10 * b + p11 * e
        if s % 8 == 7:
            top = np.maximum(np.maximum(p00, p01), np.maximum(p10, p11))
            p00, p01, p10, p11 = p00 / top, p01 / top, p10 / top, p11 / top
    into, back = np.empty((LANES, 2)), np.empty((LANES, 2))
    x, y = 0.5, 0.5
    for k in range(LANES):
        into[k] = x, y
        x, y = x * p00[k] + y * p10[k], x * p01[k] + y * p11[k]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for k in range(LANES - 1, -1, -1):
        back[k] = x, y
        x, y = p00[k] * x + p01[k] * y, p10[k] * x + p11[k] * y
        x, y = x / (x + y), y / (x + y)
    fwd = np.empty((steps, LANES))
    a0, a1 = into[:, 0], into[:, 1]
    for s in range(steps):
        a0, a1 = a0 * m00[s] + a1 * m10[s], a0 * m01[s] + a1 * m11[s]
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        fwd[s] = a1
    bwd = np.empty((steps, LANES))
    b0, b1 = back[:, 0], back[:, 1]
    for s in range(steps - 1, -1, -1):
        bwd[s] = b1  # b0 + b1 = 1
        b0, b1 = m00[s] * b0 + m01[s] * b1, m10[s] * b0 + m11[s] * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    flat = lambda v: v.T.reshape(-1)[: len(emission)]
    f1, g1 = flat(fwd), flat(bwd)
    toxic = f1 * g1
    out = toxic / (toxic + (1 - f1) * (1 - g1))
    if not edges:
        return out
    n00, n01, n10, n11 = (flat(m)[1:] for m in (m00, m01, m10, m11))
    w = [(1 - f1[:-1]) * n00 * (1 - g1[1:]), (1 - f1[:-1]) * n01 * g1[1:], f1[:-1] * n10 * (1 - g1[1:]), f1[:-1] * n11 * g1[1:]]
    total = w[0] + w[1] + w[2] + w[3]
    inner = ~first[1:]
    return out, np.array([(v / total)[inner].sum() for v in w])


class Model:
    """What scoring needs: feature weights, transitions, the logistic layer."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, layer: np.ndarray):
        self.weights, self.trans, self.layer = weights, trans, layer

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.layer[0] + summary @ self.layer[1:], -30, 30)))


def summarise(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document: log of 1 + sum of marginals, the largest, log of 1 + tokens over 1/2. No tokens: zeros."""
    n = len(bounds) - 1
    out = np.zeros((n, 3))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        at = bounds[full]
        out[full, 0] = np.log1p(np.add.reduceat(p, at))
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = np.log1p(np.add.reduceat((p > 0.5).astype(float), at))
    return out


def token_labels(docs: list[np.ndarray], names: list[str], toxic: np.ndarray) -> list[np.ndarray]:
    """1 for the tokens (numbers of names) that mark a toxic document."""
    inside, outside = Counter(), Counter()
    of = [features(w) for w in names]
    for words, y in zip(docs, toxic):
        (inside if y else outside).update({f for w in np.unique(words).tolist() for f in of[w]})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marks = {f for f, k in inside.items() if k >= max(LEAST_DOCS, LEAST_SHARE * n1) and np.log((k + 0.5) / (n1 + 1)) - np.log((outside[f] + 0.5) / (n0 + 1)) >= LEAST_ODDS}
    marked = np.array([any(f in marks for f in fs) for fs in of], dtype=float)
    return [marked[words] * y for words, y in zip(docs, toxic)]


def train(texts: list[str], toxic: list[int]) -> Model:
    """Fit the field on token labels and the logistic layer on document labels, by Adam on whole batches."""
    y = np.array(toxic, dtype=float)
    names: dict[str, int] = {}
    ids = [np.array([names.setdefault(w, len(names)) for w in WORD.findall(t.lower())], dtype=np.int64) for t in texts]
    flat = np.concatenate([*ids, np.zeros(0, np.int64)])
    truth = np.concatenate([*token_labels(ids, list(names), y), np.zeros(0)])
    bounds = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int64)
    first = np.zeros(len(flat), dtype=bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    spread = [hashed(w) for w in names]
    word_of = np.repeat(np.arange(len(names)), [len(s) for s in spread])
    feature = np.array([f for s in spread for f in s], dtype=np.int64)
    weights, steps = np.zeros(HASHED), np.zeros(6)
    bias = np.zeros(1)
    gold_edges = np.zeros(4)
    if len(flat):
        inner = ~first[1:]
        pair = (2 * truth[:-1] + truth[1:])[inner].astype(int)
        gold_edges = np.bincount(pair, minlength=4).astype(float)
    params = [weights, bias, steps]
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for turn in range(1, STEPS + 1):
        if not len(flat):
            break
        emission = (np.bincount(word_of, weights[feature], len(names)) + bias[0])[flat]
        p, edge = marginals(emission, first, np.exp(steps), edges=True)
        miss = (p - truth) / len(texts)
        by_word = np.bincount(flat, miss, len(names))
        g_w = np.bincount(feature, by_word[word_of], HASHED) + DECAY * weights
        g_start = np.array([-(miss[first].sum()), miss[first].sum()])
        g_edge = (edge - gold_edges) / len(texts)
        grads = [g_w, np.array([miss.sum()]), np.r_[g_start, g_edge] + 1e-3 * steps]
        for x, g, (m, v) in zip(params, grads, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-9)
    trans = np.exp(steps)
    model = Model(np.r_[weights, bias], trans, np.zeros(4))
    if len(flat):
        emission = (np.bincount(word_of, weights[feature], len(names)) + bias[0])[flat]
        x = summarise(marginals(emission, first, trans), bounds)
    else:
        x = np.zeros((len(texts), 3))
    layer = np.zeros(4)
    rows = np.c_[np.ones(len(x)), x]
    for _ in range(50):  # Newton's method with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(rows @ layer, -30, 30)))
        h = (rows * (q * (1 - q))[:, None]).T @ rows + 1e-2 * np.eye(4)
        layer = layer + np.linalg.solve(h, rows.T @ (y - q) - 1e-2 * layer)
    model.layer = layer
    return model


def toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """docs' columns and score (0 to 1), spans (array of start, end, probability: offsets of code points).

    labelled: rows of (text, toxic) to learn from; see TRAIN_* for how many are used, chosen by a hash of the
    text; of these a label's longest are left out while it has over half of the characters. Without a label of both kinds all scores are the share of toxic labels (0 if none). A null text counts
    as empty; a text without words gets the score of no marginal, and no spans. Texts of any length are tagged
    whole, repeated rows alike. An empty table gives an empty result.
    Columns of docs with an output's name are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, toxic = [], []
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        some = labelled.where(F.col("toxic") == label).select("text").where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
        # Hashes and lengths first: only texts that fit travel. Where not all do, the longest are left out.
        chosen = [(r.n, r.h) for r in some.select("h", F.length("text").alias("n")).orderBy("h").limit(most).collect()]
        fit, size, budget = Counter(), 0, TRAIN_CHARS // 2
        for n, h in sorted(chosen):
            if size + n <= budget or not fit:  # if even the shortest is too long, its beginning is used
                size += n
                fit[h] += 1
        hashes = spark.createDataFrame([(h,) for h in fit], "h long")
        for r in some.join(F.broadcast(hashes), "h", "left_semi").select("h", F.substring("text", 1, budget).alias("text")).orderBy("h").toLocalIterator():
            if fit[r.h]:
                fit[r.h] -= 1
                texts.append(r.text)
                toxic.append(label)
    if len(set(toxic)) < 2:
        share = float(sum(toxic)) / len(toxic) if toxic else 0.0
        model = Model(np.zeros(HASHED + 1), np.ones(6), np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0, 0, 0]))
    else:
        model = train(texts, toxic)
    del texts
    shared = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.trans, model.layer))
    out = ["score", "spans"] if with_spans else ["score"]
    rest = [n for n in docs.columns if n.lower() not in out]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
    source = docs.select(*[c(n) for n in rest], F.coalesce(c(text_col), F.lit("")).alias("_scored"))
    fields = [*source.schema.fields[:-1], T.StructField("score", T.DoubleType())] + ([T.StructField("spans", span)] if with_spans else [])

    def run(batches):
        import pyarrow as pa

        weights, trans, layer = shared.value
        model, known = Model(weights, trans, layer), {}
        claim()

        def emission(word):
            e = known.get(word)
            if e is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                e = known[word] = float(weights[hashed(word)].sum() + weights[-1])
            return e

        for batch in batches:
            n = batch.num_rows
            texts, scores, spans = batch.column(n_in := batch.num_columns - 1), np.empty(n), [None] * n
            at = 0
            while at < n:
                docs, size, begin = [], 0, at
                while at < n and (size < BATCH_TOKENS or not docs):
                    text = texts[at].as_py()
                    words = WORD.findall(text.lower())
                    docs.append(words)
                    size += len(words)
                    at += 1
                bounds = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
                e = np.fromiter((emission(w) for d in docs for w in d), dtype=float, count=size)
                first = np.zeros(size, dtype=bool)
                first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
                p = marginals(e, first, trans) if size else np.zeros(0)
                scores[begin:at] = model.score(summarise(p, bounds))
                if with_spans:
                    for k in range(len(docs)):
                        own = p[bounds[k] : bounds[k + 1]]
                        spans[begin + k] = found_spans(texts[begin + k].as_py(), own) if len(own) and own.max() > 0.5 else []
            cols = [*batch.columns[:n_in], pa.array(scores)]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return source.toDF(*[f"_{k}" for k in range(len(source.columns))]).mapInArrow(run, T.StructType(fields))


def found_spans(text: str, p: np.ndarray) -> list[dict]:
    """Runs of tokens whose marginal is over 1/2. Words are found in the lower-case text; where that has another
    length than the text, they are found in the text itself as far as the numbers of words agree."""
    lower = text.lower()
    found = list(WORD.finditer(lower if len(lower) == len(text) else text))
    if len(found) != len(p):
        found = list(WORD.finditer(lower))
    out, k = [], 0
    while k < len(p):
        if p[k] > 0.5:
            j = k
            while j + 1 < len(p) and p[j + 1] > 0.5:
                j += 1
            out.append({"start": found[k].start(), "end": found[j].end(), "probability": float(p[k : j + 1].max())})
            k = j
        k += 1
    return out


def labelled_rows(spark, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled documents that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("labelled_id"), "toxic").where("toxic IS NOT NULL AND labelled_id IS NOT NULL")
    labels = labels.where(F.crc32(F.col("labelled_id").cast("string").cast("binary")) % 3 != 1)
    # A bounded choice by a hash of the id, so that the join moves few labels and no documents.
    some = None
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        own = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("labelled_id")).limit(most)
        some = own if some is None else some.union(own)
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id")).select("text", "toxic")


def op6_crf_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = toxicity(docs, labelled_rows(spark, sf_dir, docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
