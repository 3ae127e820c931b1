"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
configurations that cover the length histogram. Multiplicative weights keep a price for each length, which
falls as the length is covered; in every round a bounded knapsack program finds, for each length that is still
short, the dearest configuration that holds it, and steps along these configurations until every length is
covered. A last knapsack over all lengths at the final prices bounds the optimum from below. The solution is
rounded at random (seeded): whole multiples are taken and fractions drawn as they go, then the rest is solved
and rounded again, and what no configuration takes goes into best-fit decreasing by runs of equal bins. All of
this works on the histogram, so its cost does not depend on the number of rows. Pieces find their place by
their rank among those of the same length."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, free_names, saved, small_batches
from .tokens import MORE_WORDS, WORDS, encoder, slices

CAPACITY = 2048
END_ID = 0
#: Of the linear program: share of a length covered by one round at most, how prices fall, lengths priced together
#: (a round deals all lengths anew into groups of at least this size), rounds (it ends long before).
STEP, FALL, GROUP, ROUNDS = 0.1, 6.0, 256, 4000
#: Of the rounding: turns of solving what is left, and the share of short pieces that is kept for the gaps of the last.
TURNS, SHORT, RESERVE = 3, 64, 0.3
#: The rounded program counts unless plain best fit needs this share of sequences less (and one).
TOLERANCE = 1e-4
SLACK = 1e-6
RESULT = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")

Config = tuple[tuple[int, int], ...]


def price(lengths: np.ndarray, values: np.ndarray, copies: np.ndarray, capacity: int, holding: np.ndarray, rng) -> tuple[float, list[dict[int, int]]]:
    """(value of the dearest multiset within capacity, for each index of holding the dearest one that holds it).

    A bounded knapsack program: copies of a length go in powers of two. Of equal values, the random order of the
    lengths decides, so that the configurations of a round differ."""
    rows = []
    for i in rng.permutation(len(lengths)).tolist():
        left, many = int(copies[i]), 1
        while left > 0:
            rows.append((i, min(many, left)))
            left, many = left - many, 2 * many
    best = np.zeros(capacity + 1)
    took = np.zeros((len(rows), capacity + 1), dtype=bool)
    for row, (i, k) in enumerate(rows):
        size = int(lengths[i]) * k
        new = best[:-size] + values[i] * k
        better = new > best[size:]
        took[row, size:] = better
        np.copyto(best[size:], new, where=better)
    room = capacity - lengths[holding]
    configs = [{int(i): 1} for i in holding]
    for row in range(len(rows) - 1, -1, -1):
        i, k = rows[row]
        for at in np.flatnonzero(took[row].take(room)).tolist():
            room[at] -= int(lengths[i]) * k
            configs[at][i] = configs[at].get(i, 0) + k
    for i, config in zip(holding.tolist(), configs):
        config[i] = min(config[i], int(copies[i]))  # never more copies than there are pieces
    return float(best[-1]), configs


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, seed: int = 5) -> tuple[list[tuple[Config, float]], float]:
    """A fractional solution that covers every length, as (configuration of (index, copies), multiplicity), and a
    lower bound of all solutions: prices whose dearest configuration costs 1 are a solution of the dual program."""
    rng = np.random.default_rng(seed)
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=float)
    m, copies = len(lengths), np.minimum(counts, capacity // lengths).astype(np.int64)
    covered = np.zeros(m)
    found: dict[Config, float] = defaultdict(float)
    # The price of a token, in steps of the coverage, so that many configurations are equally dear.
    density = lambda: np.round(np.exp(-FALL * STEP * np.floor(covered / STEP + 1e-9)) * 2**16) / 2**16 + 2.0**-20
    for _ in range(ROUNDS):
        if covered.min() >= 1 - SLACK:
            break
        prices = density() * lengths
        for group in np.array_split(rng.permutation(m), max(1, m // GROUP)):
            short = np.flatnonzero(covered[group] < 1 - SLACK)
            if not len(short):
                continue
            _, configs = price(lengths[group], prices[group], copies[group], capacity, short, rng)
            own = covered[group]
            allowed = np.where(own >= 1 - SLACK, STEP, np.minimum(STEP, 1 - own)) * counts[group]
            for at in np.argsort(own[short], kind="stable").tolist():
                config = configs[at]
                step = min(allowed[i] / k for i, k in config.items())
                if step <= 1e-12:
                    continue
                found[tuple(sorted((int(group[i]), k) for i, k in config.items()))] += step
                for i, k in config.items():
                    allowed[i] -= step * k
                    covered[group[i]] += step * k / counts[group[i]]
    for i in np.flatnonzero(covered < 1).tolist():  # by rounding errors; or all, were the rounds used up
        found[((i, int(copies[i])),)] += (1 - covered[i]) * counts[i] / copies[i]
    prices = density() * lengths
    dearest, _ = price(lengths, prices, capacity // lengths, capacity, np.zeros(0, np.int64), rng)
    bound = max(float((lengths * counts).sum()) / capacity, float((prices * counts).sum()) / dearest)
    return list(found.items()), bound


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing by runs: (lengths in one bin, number of such bins)."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    spaces = np.zeros(capacity + 1, dtype=bool)
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            fits = np.flatnonzero(spaces[size:])
            if len(fits):
                space = int(fits[0]) + size
                bins, n = room[space].popitem()
                many = min(n, left)
                if n > many:
                    room[space][bins] = n - many
                spaces[space] = bool(room[space])
                into, times = bins + (size,), many
                left -= many
                space -= size
            else:
                each = capacity // size
                into, times = (size,) * min(each, left), left // min(each, left)
                left -= times * len(into)
                space = capacity - size * len(into)
            room[space][into] = room[space].get(into, 0) + times
            spaces[space] = True
    return [(bins, n) for groups in room.values() for bins, n in groups.items()]


def rounded(solution: list[tuple[Config, float]], counts: np.ndarray, rng) -> tuple[dict[Config, int], np.ndarray]:
    """(whole multiples of configurations, counts that are left). Fractions are rounded up as often as they say, so
    that what is left has about the mixture of the whole."""
    left, kept, up = counts.copy(), defaultdict(int), []
    for config, times in solution:
        many = min([int(times), *(int(left[i]) // k for i, k in config)])
        if many > 0:
            kept[config] += many
            for i, k in config:
                left[i] -= many * k
        if rng.random() < times - int(times):
            up.append(config)
    rng.shuffle(up)
    for config in up:
        if all(left[i] >= k for i, k in config):
            kept[config] += 1
            for i, k in config:
                left[i] -= k
    return kept, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences); together they hold the histogram.

    The first entries are configurations of the program, the others are best-fit bins."""
    counts_of = {s: n for s, n in histogram.items() if n > 0}
    if any(s > capacity or s < 1 for s in counts_of):
        raise ValueError("lengths must be 1 to the capacity")
    whole = counts_of.pop(capacity, 0)
    made: list[tuple[tuple[int, ...], int]] = [((capacity,), whole)] if whole else []
    if not counts_of:
        return made
    rng = np.random.default_rng(1)
    lengths = np.array(sorted(counts_of))
    rest = np.array([counts_of[int(x)] for x in lengths], dtype=np.int64)
    reserve = np.where(lengths <= SHORT, np.ceil(RESERVE * rest), 0).astype(np.int64)
    of = lambda some: {int(x): int(n) for x, n in zip(lengths, some) if n}
    total = lambda bins: sum(n for _, n in bins)
    kept: list = []
    best: list = []
    for _ in range(TURNS):
        use = np.flatnonzero(rest)
        if not len(use):
            break
        solution, _ = solve(lengths[use], rest[use], capacity)
        full = [(tuple((int(use[i]), k) for i, k in config), times) for config, times in solution if sum(int(lengths[use[i]]) * k for i, k in config) == capacity]
        held = np.minimum(reserve, rest)
        new, left = rounded(full, rest - held, rng)  # others are better filled by best fit
        rest = left + held
        kept = kept + [(tuple(int(lengths[i]) for i, k in config for _ in range(k)), n) for config, n in new.items()]
        candidate = kept + best_fit(of(rest), capacity)
        if not best or total(candidate) <= total(best):
            best = candidate
        if not new:
            break
    plain = best_fit(counts_of, capacity)
    if total(best) > total(plain) + max(1, TOLERANCE * total(plain)):
        best = plain
    return made + best


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """A row for each piece of each document: id_col, piece, start, length, ids_crc32 (and ids).

    A document's ids are followed by END_ID; only longer ones are cut, into pieces of the capacity. A null
    text counts as empty: one piece with END_ID alone. Repeated rows have a piece each. An id column that is named
    like another column of the result gets a leading _. words: how many a worker remembers."""
    small_batches(docs.sparkSession)
    source = docs.select(c(id_col).alias("id"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    ident = "_" + id_col if id_col.lower() in RESULT else id_col
    fields = [T.StructField(ident, source.schema[0].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def cut(batches):
        import pyarrow as pa

        encode = encoder(tokenizer, words).encode
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, raw in enumerate(encode(texts)):
                    raw += end
                    n = len(raw) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        part = raw[4 * s : 4 * (s + capacity)]
                        row.append(at + k)
                        piece.append(p)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(cut, T.StructType(fields))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (with a column `length`, of 1 to the capacity, and none named like the two that are added) and
    sequence_id, offset: lengths in a sequence add up to capacity at most."""
    spark = cut.sparkSession
    mid, part_col, n_col, earlier_col, own_col, rank = free_names(cut, "_mid", "_part", "_n", "_earlier", "_own", "_rank")
    kept = saved(cut.withColumn(mid, F.monotonically_increasing_id()), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    base = 0
    for lengths, times in plan(histogram, capacity):
        at = 0
        for size in lengths:
            rows.append((size, times, base, at))
            at += size
        base += times
    rows.sort(key=lambda r: r[0])
    # Pieces of one length take the places in this order.
    size, times, first, place = (np.array([r[k] for r in rows], dtype=np.int64) for k in range(4))
    before = np.cumsum(times) - times
    if len(rows):
        new = np.r_[True, size[1:] != size[:-1]]
        before = before - np.repeat(before[new], np.diff(np.r_[np.flatnonzero(new), len(size)]))
    starts = size * (1 << 40) + before

    # The rank of each piece among its length: those of earlier partitions, then those before it in its own.
    part = F.shiftright(F.col(mid), 33)
    by_part = kept.groupBy(part.alias(part_col), "length").agg(F.count(F.lit(1)).alias(n_col))
    before_it = Window.partitionBy("length").orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_part.select(part_col, "length", F.coalesce(F.sum(n_col).over(before_it), F.lit(0)).alias(earlier_col))
    own = kept.withColumn(part_col, part).withColumn(own_col, F.row_number().over(Window.partitionBy(part_col, "length").orderBy(mid)) - 1)
    ranked = own.join(earlier, [part_col, "length"]).withColumn(rank, F.col(earlier_col) + F.col(own_col))
    ranked = ranked.select(*[c(n) for n in cut.columns], rank)
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length = cut.columns.index("length")

    def place_rows(batches):
        import pyarrow as pa

        for batch in batches:
            lengths, ranks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (at_length, batch.num_columns - 1))
            k = np.searchsorted(starts, lengths * (1 << 40) + ranks, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(first[k] + ranks - before[k]), pa.array(place[k])], names=schema.names)

    return ranked.mapInArrow(place_rows, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Pieces of documents with their sequence and place. An empty table gives an empty result; columns other
    than the id and the text are not carried."""
    return pack(pieces(docs, tokenizer, id_col, text_col, capacity, with_ids, words), capacity)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), words=MORE_WORDS).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
