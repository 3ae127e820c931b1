"""I-Match fingerprints over randomised lexicons.

Document frequencies of all words give a lexicon: the words whose inverse document frequency lies in a
band. A document's terms are its distinct words in that lexicon, sorted. Randomised subsets of the lexicon
(of several rates, so that some fit short documents and some long ones) each select some of the terms, and
the sorted selection is hashed; a further hash takes all of the terms. Documents that differ in a few words
keep the hashes of all subsets that hold none of those words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import c, free_names, partitions, row_hash, saved

#: A subset of level l holds one in CELLS[l] words; each level has SUBSETS disjoint ones.
CELLS, SUBSETS = (16, 64, 256, 1024), 15
WORDS = r"[^\\p{L}\\p{N}]+"
SLOTS = 1 << 15
#: A lexicon beyond this many words is joined instead of sent to all executors.
MOST_WORDS = 1_000_000
LEAST_INFORMED = 6
#: Buckets that neighbours are found in: bytes of one, their greatest number, and what a row counts beside its strings.
BUCKET_BYTES, MOST_BUCKETS, ROW_BYTES = 64 << 20, 1 << 18, 256
#: What hash() gives for an empty array.
EMPTY = 42


def words_sql(text: str) -> str:
    """The distinct words of a text, sorted."""
    return f"sort_array(array_distinct(filter(split(lower({text}), '{WORDS}'), w -> w != '')))"


def lexicon(df: DataFrame, text_col: str, least_share: float, most_share: float) -> DataFrame:
    """The words (term) in at least two documents and between the two shares of all documents.

    Shares of one document's words add up to at most its distinct words, so the lexicon has at most (mean
    distinct words a document) / least_share words, whatever the number of documents."""
    total = df.count()
    words = df.select(F.explode(F.expr(words_sql("coalesce(`%s`, '')" % text_col.replace("`", "``")))).alias("term"))
    df_of = words.groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    return df_of.where((F.col("docs") >= max(2.0, least_share * total)) & (F.col("docs") <= max(2.0, most_share * total))).select("term")


def slots(spark, lex: DataFrame) -> DataFrame:
    """One row with an array: the lexicon's words by hash slot, for look-ups inside a row."""
    by_slot = lex.groupBy(F.expr(f"pmod(xxhash64(term), {SLOTS})").alias("slot")).agg(F.collect_list("term").alias("terms"))
    every = spark.range(SLOTS).join(by_slot, F.col("id") == F.col("slot"), "left")
    return every.agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(terms, cast(array() as array<string>)) AS terms))), x -> x.terms)").alias("lex"))


def _terms_sql(words: str) -> str:
    """array<struct<h, m>> of sorted terms: hash, and a bit for each subset that holds the term."""
    bits = []
    at = 0
    for level, cells in enumerate(CELLS):
        cell = f"(shiftrightunsigned(h, {at}) & {cells - 1})"
        bits.append(f"if({cell} < {SUBSETS}, shiftleft(1L, CAST({cell} + {SUBSETS * level} AS INT)), 0L)")
        at += cells.bit_length() - 1
    # A second hash, so that subsets don't depend on the slots
    return f"transform(transform({words}, w -> xxhash64(w, 'lexicon')), h -> named_struct('h', h, 'm', {' | '.join(bits)}))"


def _prints_sql(terms: str, sparse: str, text: str) -> str:
    """array<int>: the hash of all terms, then one of each subset (EMPTY: it holds none of the terms)."""
    hashes = [f"hash(filter({terms if k < SUBSETS else sparse}, x -> x.m & {1 << k}L != 0))" for k in range(SUBSETS * len(CELLS))]
    return f"array(if(size({terms}) = 0, hash(lower({text})), hash({terms})), {', '.join(hashes)})"


def fingerprints(df: DataFrame, text: str, lex: DataFrame, out: str, joined: bool = False) -> DataFrame:
    """df with the array<int> of hashes of its column text. A text without a word of the lexicon is
    represented by all its words, one without words by itself. joined: look words up by a join."""
    words, found, terms, sparse, key = free_names(df, "_words", "_found", "_terms", "_sparse", "_key")
    q = f"`{text}`"
    step = df.withColumn(words, F.expr(words_sql(q)))
    if joined:
        base = df.withColumn(key, F.xxhash64(c(text)))
        per = (
            base.select(key, F.explode(F.expr(words_sql(q))).alias("term")).distinct().join(lex, "term")
            .groupBy(key).agg(F.array_sort(F.collect_list("term")).alias(found))
        )
        step = base.withColumn(words, F.expr(words_sql(q))).join(per, key, "left").drop(key).withColumn(found, F.expr(f"coalesce({found}, cast(array() as array<string>))"))
    else:
        table = free_names(df, "_lex")[0]
        step = step.withColumn(table, lex.scalar()).withColumn(found, F.expr(f"filter({words}, w -> array_contains(element_at({table}, CAST(pmod(xxhash64(w), {SLOTS}) + 1 AS INT)), w))")).drop(table)
    step = step.withColumn(terms, F.expr(_terms_sql(f"if(size({found}) > 0, {found}, {words})")))
    step = step.withColumn(sparse, F.expr(f"filter({terms}, x -> shiftrightunsigned(x.m, {SUBSETS}) != 0)"))
    return step.withColumn(out, F.expr(_prints_sql(terms, sparse, q))).drop(words, found, terms, sparse)


def as_text(prints: str):
    """Hexadecimal digits, eight a hash."""
    return F.expr(f"array_join(transform({prints}, x -> lpad(hex(CAST(x AS BIGINT) & 4294967295L), 8, '0')), '')")


def likeness(a: str, b: str):
    """0 to 1. Equal hashes of all terms: 1. Else the share of subsets whose hashes agree, of those that hold
    a term of either document, at the sparsest level with enough of them (else over all levels)."""
    codes = f"slice(zip_with({a}, {b}, (x, y) -> if(x = {EMPTY} AND y = {EMPTY}, 0, if(x = y, 2, 1))), 2, {SUBSETS * len(CELLS)})"
    share = lambda s: f"size(filter({s}, z -> z = 2)) / size(filter({s}, z -> z > 0))"
    cases = "".join(f" WHEN size(filter(slice(codes, {1 + SUBSETS * k}, {SUBSETS}), z -> z > 0)) >= {LEAST_INFORMED} THEN {share(f'slice(codes, {1 + SUBSETS * k}, {SUBSETS})')}" for k in reversed(range(len(CELLS))))
    body = f"CASE{cases} WHEN size(filter(codes, z -> z > 0)) > 0 THEN {share('codes')} ELSE 0D END"
    return F.expr(f"if({a}[0] = {b}[0], 1D, element_at(transform(array({codes}), codes -> {body}), 1))")


def imatch(df: DataFrame, text_col: str = "text", least_share: float = 5e-4, most_share: float = 0.05) -> tuple[DataFrame, DataFrame, bool]:
    """(df with `fingerprint` array<int>, the lexicon table for fingerprints(), whether it is to be joined).

    A null text counts as empty. Equal texts have equal fingerprints. Texts of any length are taken whole. A column
    of df named fingerprint is replaced; no other name clashes. An empty table gives an empty result."""
    spark = df.sparkSession
    lex = saved(lexicon(df, text_col, least_share, most_share), "lexicon")
    joined = lex.count() > MOST_WORDS
    table = lex if joined else saved(slots(spark, lex).coalesce(1), "lexslots")
    text = free_names(df, "_text")[0]
    out = fingerprints(df.withColumn(text, F.coalesce(c(text_col), F.lit(""))), text, table, "fingerprint", joined).drop(text)
    return out, table, joined


def bucket_starts(df: DataFrame, size, order: list[str], least: int) -> tuple[DataFrame, int]:
    """(one row with an array of the keys at which buckets begin, their greatest number), for the rows of df in
    ascending order of two whole-number columns: each bucket has about the same sum of size.

    Only these columns are exchanged. The driver gets a number a partition."""
    spark = df.sparkSession
    slim = saved(df.select(c(order[0]).alias("a"), c(order[1]).alias("b"), size.alias("size")), "sizes")
    ranged = saved(slim.repartitionByRange(partitions(spark), "a", "b").withColumn("part", F.spark_partition_id()), "ranges")
    sums = sorted((r[0], r[1]) for r in ranged.groupBy("part").agg(F.sum("size")).collect())
    total = sum(s for _, s in sums)
    n = min(max(1, least, -(-total // BUCKET_BYTES)), MOST_BUCKETS)
    a_bucket = max(1, -(-total // n))
    rows, at = [], 0
    for part, s in sums:
        rows.append((part, at))
        at += s
    before = ranged.join(F.broadcast(spark.createDataFrame(rows, "part int, held long")), "part")  # a row for each partition
    own = Window.partitionBy("part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    place = before.select("a", "b", ((F.col("held") + F.coalesce(F.sum("size").over(own), F.lit(0))) / F.lit(a_bucket)).cast("long").alias("bucket"))
    starts = place.groupBy("bucket").agg(F.min(F.struct("a", "b")).alias("key"))
    return starts.agg(F.sort_array(F.collect_set("key")).alias("starts")), n


def with_next(df: DataFrame, id_col: str, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """df with, for each of cols, next_<col>: the value in the next row in descending order of id_col (nulls
    last, ties by a hash of the columns `by`, or of all); the last row gets the first row's. Ids are whole numbers
    (else a TypeError). Columns of df that are named next_<col> are replaced; no other name clashes. An empty table
    gives an empty result, a single row is its own next one.

    Rows go to buckets that follow each other in this order, of about BUCKET_BYTES of the strings among `by` (more
    beyond MOST_BUCKETS of them) or less; rows of one id may part, only rows whose hashes agree too may not. The
    first row of each bucket also goes, marked, to the end of the bucket before, so each bucket is whole in the one
    exchange that carries full rows."""
    spark = df.sparkSession
    if df.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} is not a column of whole numbers")
    down, tie, bucket, ghost, places, table = free_names(df, "_down", "_tie", "_bucket", "_ghost", "_places", "_starts")
    known = df.select(*[c(x) for x in by or df.columns])
    strings = [F.coalesce(F.octet_length(c(x)), F.lit(0)).cast("long") for x, t in known.dtypes if t in ("string", "binary")]
    number = F.coalesce(c(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = df.withColumn(down, F.bitwise_not(number)).withColumn(tie, row_hash(known))  # ~x falls as x rises
    found, n = bucket_starts(keyed, sum(strings, F.lit(ROW_BYTES).cast("long")), [down, tie], 2 * partitions(spark))
    starts = saved(found.withColumnRenamed("starts", table), "starts")
    key = f"named_struct('a', {down}, 'b', {tie})"
    middle = "CAST((s.lo + s.hi) DIV 2 AS INT)"
    step = f"if(s.lo >= s.hi, s, if({table}[{middle}] <= {key}, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    at_most = f"aggregate(sequence(0, {n.bit_length()}), named_struct('lo', 0, 'hi', size({table})), (s, k) -> {step}, s -> s.lo)"
    placed = keyed.withColumn(table, starts.scalar()).withColumn(bucket, F.expr(f"{at_most} - 1"))
    own, before = f"named_struct('b', {bucket}, 'g', false)", f"named_struct('b', pmod({bucket} - 1, size({table})), 'g', true)"
    placed = placed.withColumn(places, F.expr(f"if({table}[{bucket}] = {key}, array({own}, {before}), array({own}))"))
    kept = [c(x) for x in df.columns]
    step = placed.select(*kept, down, tie, F.explode_outer(places).alias(places)).select(*kept, down, tie, F.col(f"{places}.b").alias(bucket), F.col(f"{places}.g").alias(ghost))
    w = Window.partitionBy(bucket).orderBy(F.col(ghost), F.col(down), F.col(tie))
    step = step.repartitionById(n, F.col(bucket))
    for x in cols:
        step = step.withColumn(f"next_{x}", F.lead(c(x)).over(w))
    return step.where(~F.col(ghost)).drop(down, tie, bucket, ghost)


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own, table, joined = imatch(docs)
    pairs = with_next(own, "doc_id", ["text", "fingerprint"], by=["doc_id", "text"])
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("cut", F.floor(F.col("n_chars") / 3).cast("int"))
    pairs = pairs.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - cut), substring(next_text, 1, cut))")).drop("text", "next_text")
    both = fingerprints(pairs, "edited", table, "edited_print", joined)
    return both.select("doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text("fingerprint").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"), likeness("fingerprint", "edited_print").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
