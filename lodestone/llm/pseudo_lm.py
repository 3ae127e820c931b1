"""Masked pseudo-likelihood: a network predicts each token from those on both sides of it.

Tokens are words and marks. The network adds one vector for each of the WINDOW tokens before and after, takes a
hyperbolic tangent, and predicts the class of a symbol and then the symbol within its class, so the cost does
not grow with the vocabulary. The most frequent words are symbols of their own; the others share symbols by
their ending, and within such a symbol each word has its share of the symbol's count over all documents. So
every word of the corpus has a probability, and all of them add up to one.

Texts are cut into words once, and written as numbers. A task numbers the words it meets itself, a segment of
them at a time, and writes the segment's words and counts beside; these are added up over all documents, and each
segment gets a file with the symbol and share of each of its numbers. What is counted and written thus grows
with the corpus, and no task holds more than a segment's words. Training takes one pass over every token of all
documents: a small turn and then the rest, in all tasks at once, weights being averaged by tokens seen after
each turn. The summed conditional log-probabilities of all tokens score a document."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, claim, partitions, saved, scratch, small_batches
from .huffman_ids import get, put
from .tokens import slices

WINDOW = 2
CLASSES, PER = 40, 64
#: Symbols in all (0 is the edge), and those that words share by their ending.
SYMBOLS, ENDINGS = CLASSES * PER, 255
OWN = SYMBOLS - ENDINGS - 1
HIDDEN = 16
RATE = 0.1
#: One in FIRST documents (by a hash) makes the first turn; tokens in a step of the two turns.
FIRST, STEPS = 16, (1024, 8192)
#: Words that a task numbers before it starts a new segment.
SEGMENT_WORDS = 150_000
CHUNK = 1 << 14
EDGE = 0  # the symbol beyond a document's ends

WORD = re.compile(r"\w+|[^\w\s]")
#: The same for text of Latin-1 alone, with its word characters written out: a look-up in a bitmap, not a test of the class.
LATIN_1 = "".join(map(re.escape, re.findall(r"\w", "".join(map(chr, range(256))))))
LATIN_WORD = re.compile(rf"[{LATIN_1}]+|[^{LATIN_1}\s]")
PLACES = (*range(-WINDOW, 0), *range(1, WINDOW + 1))


def words_of(text: str) -> list[str]:
    """The matches of WORD in a text in lower case."""
    text = text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return WORD.findall(text)
    return LATIN_WORD.findall(text)


def contexts(docs: list[np.ndarray]) -> np.ndarray:
    """(2 * WINDOW, tokens): the symbols at each place around each token of all docs, EDGE beyond a document's ends."""
    edge = np.full(WINDOW, EDGE, np.int32)
    line = np.concatenate([x for d in docs for x in (edge, d)] + [edge])
    sizes = np.array([len(d) for d in docs])
    at = np.arange(sizes.sum()) + np.repeat(WINDOW * np.arange(1, len(docs) + 1), sizes)
    return np.stack([line[at + d] for d in PLACES])


class Net:
    """Weights: around (places, symbols, hidden), their bias, class (hidden + 1, classes), within (classes, hidden + 1, symbols of a class)."""

    SHAPES = ((2 * WINDOW, SYMBOLS, HIDDEN), (HIDDEN,), (HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, PER))

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.concatenate([rng.normal(0, 0.1, sizes[0]), np.zeros(sizes[1]), rng.normal(0, 0.1, sizes[2]), rng.normal(0, 0.1, sizes[3])])
        self.flat = np.array(flat, dtype=np.float32)
        self.around, self.bias, self.by_class, self.within = self._views(self.flat)
        self.squares = None

    def _views(self, flat: np.ndarray) -> list[np.ndarray]:
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        return [flat[e - n : e].reshape(s) for e, n, s in zip(np.cumsum(sizes), sizes, self.SHAPES)]

    def _hidden(self, ctx: np.ndarray) -> np.ndarray:
        """Hidden values, and a last column of ones for the bias of what follows."""
        h = np.ones((ctx.shape[1], HIDDEN + 1), np.float32)
        inner = self.around[0].take(ctx[0], axis=0)
        for k in range(1, len(ctx)):
            inner += self.around[k].take(ctx[k], axis=0)
        inner += self.bias
        np.tanh(inner, out=h[:, :HIDDEN])
        return h

    def _safe(self) -> bool:
        """Hidden values are within 1, so no logit is beyond these sums: exp() needs no shift while they are small."""
        return max(np.abs(self.by_class).sum(axis=0).max(), np.abs(self.within).sum(axis=1).max()) < 80

    def log_probabilities(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(target | both sides) of each token."""
        return self._run(ctx, target, False)

    def train(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """One step of AdaGrad on the mean loss of a batch; the log-probabilities before it. Rows of `around` that
        the batch doesn't use stay as they are."""
        if self.squares is None:
            self.squares = self._views(np.full(len(self.flat), 1e-3, np.float32))
        return self._run(ctx, target, True)

    def _run(self, ctx: np.ndarray, target: np.ndarray, learn: bool) -> np.ndarray:
        m, safe = len(target), self._safe()
        order = np.argsort((target // PER).astype(np.uint16), kind="stable")
        ctx, target = ctx.take(order, axis=1), target.take(order)
        cls = target // PER
        n, edges = np.arange(m), np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        spans = [(k, edges[k], edges[k + 1]) for k in range(CLASSES) if edges[k] < edges[k + 1]]
        h = self._hidden(ctx)

        def predicted(z, k):
            """(log-probabilities of k, scale); z becomes the gradient of the loss by the logits, but for the scale of its rows."""
            if not safe:
                z -= z.max(axis=1, keepdims=True)
            flat, at = z.reshape(-1), n * z.shape[1] + k
            own = flat.take(at)
            np.exp(z, out=z)
            total = z @ np.ones(z.shape[1], np.float32)
            if learn:
                flat[at] -= total
            return own - np.log(total), (np.float32(1 / m) / total)[:, None]

        by_class = h @ self.by_class
        p, scale_class = predicted(by_class, cls)
        z = np.empty((m, PER), np.float32)
        for k, a, b in spans:
            np.matmul(h[a:b], self.within[k], out=z[a:b])
        more, scale = predicted(z, target - cls * PER)
        out = np.empty(m, np.float32)
        out[order] = p + more
        if learn:
            g_h = by_class @ self.by_class[:HIDDEN].T
            g_h *= scale_class
            back, scaled, g_within = np.empty((m, HIDDEN), np.float32), h * scale, np.zeros(self.SHAPES[3], np.float32)
            for k, a, b in spans:
                np.matmul(z[a:b], self.within[k, :HIDDEN].T, out=back[a:b])
                np.matmul(scaled[a:b].T, z[a:b], out=g_within[k])
            back *= scale
            g_h += back
            inner = h[:, :HIDDEN]
            g_h *= 1 - inner * inner
            self._step(self.within, self.squares[3], g_within)
            self._step(self.by_class, self.squares[2], (h * scale_class).T @ by_class)
            self._step(self.bias, self.squares[1], g_h.sum(axis=0))
            for k in range(len(ctx)):
                order = np.argsort(ctx[k].astype(np.uint16), kind="stable")
                symbols = ctx[k].take(order)
                starts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
                # Pairs of values as complex numbers: half as many to add.
                g = np.add.reduceat(g_h.take(order, axis=0).view(np.complex64), starts, axis=0).view(np.float32)
                rows = symbols.take(starts)
                weights, squares = self.around[k].take(rows, axis=0), self.squares[0][k].take(rows, axis=0)
                self._step(weights, squares, g)
                self.around[k][rows], self.squares[0][k][rows] = weights, squares
        return out

    @staticmethod
    def _step(weights: np.ndarray, squares: np.ndarray, g: np.ndarray) -> None:
        squares += g * g
        weights -= RATE * g / np.sqrt(squares)


def numbered(docs: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """A written table: a row of kind 0 for each of docs, with the numbers of its words in its segment (and turn, the
    turn that it is learned in), and a row of kind 1 for each segment, with its words and their counts."""
    source = docs.select(*[c(n).alias(f"_{k}") for k, n in enumerate(carry)], F.coalesce(c(text_col), F.lit("")).alias("_text"))
    kept = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("turn", T.IntegerType()), T.StructField("segment", T.LongType()), *kept, T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    class Numbers(dict):
        def __missing__(self, word):
            n = self[word] = len(self)
            return n

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        claim()
        segment, numbers, counts, types = TaskContext.get().partitionId() << 20, Numbers(), np.zeros(0, np.int64), []
        names = schema.names

        def rows(kind, turns, columns, ids, words, counts):
            n = len(turns)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(turns, pa.int32()), pa.array([segment] * n, pa.int64()), *columns, pa.array(ids, pa.binary()), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=names)

        def vocabulary():
            return rows(1, [None], [pa.nulls(1, t) for t in types], [None], [list(numbers)], [counts])

        for batch in batches:
            last = batch.num_columns - 1
            types = [batch.column(k).type for k in range(last)]
            for at, texts in slices(batch.column(last)):
                found = [words_of(t) for t in texts]
                ids = [np.fromiter(map(numbers.__getitem__, w), dtype="<u4", count=len(w)) for w in found]
                more = np.bincount(np.concatenate(ids), minlength=len(numbers))
                more[: len(counts)] += counts
                counts = more
                raw = [x.tobytes() for x in ids]
                turns = [0 if zlib.crc32(x) % FIRST == 0 else 1 for x in raw]
                yield rows(0, turns, [batch.column(k).slice(at, len(texts)) for k in range(last)], raw, [None] * len(raw), [None] * len(raw))
                if len(numbers) >= SEGMENT_WORDS:
                    yield vocabulary()
                    segment, numbers, counts = segment + 1, Numbers(), np.zeros(0, np.int64)
        if numbers:
            yield vocabulary()

    return saved(source.mapInArrow(run, schema), "lm-numbered")


def word_table(table: DataFrame) -> DataFrame:
    """A written table: word, n (its count in all documents), symbol, log_share (of the symbol's count)."""
    spark = table.sparkSession
    counts = saved(_words(table).groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()]  # as many as the network has symbols for
    own = spark.createDataFrame([(w, 1 + k) for k, w in enumerate(top)], "word string, own int")
    ending = F.pmod(F.crc32(F.encode(F.substring("word", -2, 2), "utf-8")), F.lit(ENDINGS)).cast("int")
    named = counts.join(F.broadcast(own), "word", "left").withColumn("symbol", F.coalesce("own", ending + (1 + OWN))).drop("own")
    totals = named.groupBy("symbol").agg(F.sum("n").alias("total"))
    return saved(named.join(F.broadcast(totals), "symbol").select("word", "n", "symbol", F.log(F.col("n") / F.col("total")).alias("log_share")), "lm-words")


def _words(table: DataFrame) -> DataFrame:
    """segment, at (the number), word, n."""
    each = F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")
    return table.where("kind = 1").select("segment", each).select("segment", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))


def write_segments(table: DataFrame, words: DataFrame, path: str) -> None:
    """A file for each segment: the symbol of each of its numbers, and the logarithm of the word's share in it."""
    placed = _words(table).select("segment", "at", "word").join(words.select("word", "symbol", "log_share"), "word").select("segment", "at", "symbol", "log_share")
    placed = placed.repartition(partitions(table.sparkSession), "segment").sortWithinPartitions("segment")  # one whole number: a radix sort; numbers are put in their places below

    def write(batches):
        import pyarrow as pa

        key, held = None, []

        def flush():
            at, of_each, shares_of_each = (np.concatenate([x[k] for x in held]) for k in range(3))
            symbols, shares = np.empty(len(at), "<u2"), np.empty(len(at), "<f4")
            symbols[at], shares[at] = of_each, shares_of_each
            put(f"{path}/{key}.seg", symbols.tobytes() + shares.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([len(symbols)], pa.int64())], names=["segment", "words"])

        for batch in batches:
            of, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            edges = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(0, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and int(of[a]) != key:
                    yield flush()
                    held = []
                key = int(of[a])
                held.append([x[a:b] for x in columns])
        if held:
            yield flush()

    saved(placed.mapInArrow(write, "segment long, words long"), "lm-segments", f"{path}/manifest")


class Segments:
    """The files of segments, one in memory at a time."""

    def __init__(self, path: str):
        self.path, self.key = path, None

    def of(self, segment: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, logarithms of shares) of a document's numbers."""
        if segment != self.key:
            data = get(f"{self.path}/{segment}.seg")
            words = len(data) // 6
            self.key, self.symbols, self.shares = segment, np.frombuffer(data, "<u2", words).astype(np.int32), np.frombuffer(data, "<f4", words, 2 * words)
        ids = np.frombuffer(raw, "<u4")
        return self.symbols[ids], self.shares[ids]


def train_on(table: DataFrame, path: str, turn: int, start: np.ndarray) -> np.ndarray:
    """Weights after one pass over every token of the documents of a turn, the mean over tasks by tokens seen.

    Each task sends its weights in chunks, times its tokens; chunks are added up as they stream by."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(start)

    def local(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        claim()
        net, segments, seen, step = Net(shared.value), Segments(path), 0, STEPS[turn]
        docs, have = [], 0
        rng = np.random.default_rng(11)

        def learn():
            nonlocal docs, have, seen
            x, y = contexts(docs), np.concatenate(docs)
            order = rng.permutation(len(y))
            for s in range(0, len(y), step):
                own = order[s : s + step]
                net.train(x.take(own, axis=1), y.take(own))
            seen += len(y)
            docs, have = [], 0

        for batch in batches:
            for at, raw in slices(batch.column(1)):
                for segment, ids in zip(batch.column(0).slice(at, len(raw)).to_pylist(), raw):
                    if ids:
                        docs.append(segments.of(segment, ids)[0])
                        have += len(docs[-1])
                    if have >= 16 * step:
                        learn()
        if have:
            learn()
        if seen:
            salt = TaskContext.get().partitionId() % 32
            parts = [net.flat[k : k + CHUNK].astype(np.float64) * seen for k in range(0, len(net.flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([salt] * len(parts), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], names=["chunk", "salt", "seen", "v"])

    def add(batches):
        import pyarrow as pa

        key, held, seen = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([seen], pa.int64()), pa.array([held.astype(np.float32).tobytes()], pa.binary())], names=["chunk", "salt", "seen", "v"])
        for batch in batches:
            for k in range(batch.num_rows):
                new, n = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_py()
                v = np.frombuffer(batch.column(3)[k].as_py(), np.float32).astype(np.float64)
                if new == key:
                    held, seen = held + v, seen + n
                else:
                    if key is not None:
                        yield row()
                    key, held, seen = new, v, n
        if key is not None:
            yield row()

    n, kind = partitions(spark), "chunk int, salt int, seen long, v binary"
    got = table.where(F.col("turn") == turn).select("segment", "ids").mapInArrow(local, kind)
    got = got.repartition(n, "chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(add, kind)
    got = got.withColumn("salt", F.lit(0)).repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(add, kind)
    out = np.array(start, dtype=np.float32)
    for r in got.collect():  # as many numbers as the network has, whatever the input
        v = np.frombuffer(r.v, np.float32)
        out[r.chunk * CHUNK : r.chunk * CHUNK + len(v)] = v / r.seen
    return out


def pseudo_likelihood(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those named in carry) and n_tokens, log_probability (the sum over all tokens),
    mean_log_probability, pseudo_perplexity.

    A null text counts as empty; a text without tokens has sum 0 and null means. Repeated rows are scored alike. An
    empty table gives an empty result. Texts of any length are scored whole. Columns of docs with an output's name
    are replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    out = ["n_tokens", "log_probability", "mean_log_probability", "pseudo_perplexity"]
    rest = [n for n in (docs.columns if carry is None else carry) if n.lower() not in out]
    table = numbered(docs, text_col, rest)
    path = scratch(spark, "lm")
    write_segments(table, word_table(table), path)
    flat = Net().flat
    for turn in range(len(STEPS)):
        flat = train_on(table, path, turn, flat)
    shared = spark.sparkContext.broadcast(flat)
    types = [docs.schema[n].dataType for n in rest]
    fields = [T.StructField(n, t) for n, t in zip(rest, types)] + [T.StructField("n_tokens", T.LongType())] + [T.StructField(n, T.DoubleType()) for n in out[1:]]

    def run(batches):
        import pyarrow as pa

        claim()
        net, segments = Net(shared.value), Segments(path)
        for batch in batches:
            last = batch.num_columns - 1
            for at, raw in slices(batch.column(last)):
                of = batch.column(last - 1).slice(at, len(raw)).to_pylist()
                n = np.array([len(x) // 4 for x in raw])
                total = np.zeros(len(raw))
                full = np.flatnonzero(n)
                if len(full):
                    known = [segments.of(of[k], raw[k]) for k in full.tolist()]
                    x, y = contexts([d for d, _ in known]), np.concatenate([d for d, _ in known])
                    p = np.concatenate([net.log_probabilities(x[:, s : s + 16384], y[s : s + 16384]) for s in range(0, len(y), 16384)]).astype(float)
                    total[full] = np.add.reduceat(p + np.concatenate([s for _, s in known]), (np.cumsum(n) - n)[full])
                mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(at, len(raw)) for i in range(last - 1)), pa.array(n, pa.int64()), pa.array(total), pa.array(mean, pa.float64()), pa.array([None if m is None else float(np.exp(-m)) for m in mean], pa.float64())],
                    names=[f.name for f in fields],
                )

    return table.where("kind = 0").select(*[f"_{k}" for k in range(len(rest))], "segment", "ids").mapInArrow(run, T.StructType(fields))


def op4_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudo_likelihood(docs, carry=["doc_id"]).select("doc_id", "n_tokens", "log_probability", "mean_log_probability", "pseudo_perplexity")
