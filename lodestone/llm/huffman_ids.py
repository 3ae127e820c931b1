"""Token ids in files: canonical length-limited Huffman codes from global counts, blocks that decode alone.

A file (.hid) is: MAGIC; length of the header; header (JSON: ids a block, numbers of documents and ids, bytes of
names); the names of its documents (an Arrow stream of one column); per document its number of ids (unsigned
32-bit); per block the bit at which it starts (unsigned 64-bit); bits, most significant first, as big-endian 32-bit words. The code lengths, from which the canonical
codes follow, are in one file beside (codes.npz). A reader decodes all blocks of a file in step by one table."""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, discard, partitions, row_hash, saved, scratch, small_batches
from .tokens import MORE_WORDS, encoder, slices

MAGIC = b"HID2"
LIMIT, BLOCK, IDS_A_FILE = 16, 2048, 8_000_000
END_ID = 0


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, dtype=np.int64)
    for _ in range(limit):
        both = np.concatenate([weight, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))  # which of the sorted items are leaves
        both = both[rank]
        both = both[: len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take = 2 * len(order) - 2
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    code = last = 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def tables(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits looked at, id and code length by those bits)."""
    limit = max(1, int(lengths.max(initial=1)))
    ids, sizes = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.uint8)
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    first = codes[used] << (limit - lengths[used]).astype(np.uint64)
    for i, at in zip(used.tolist(), first.tolist()):
        width = 1 << (limit - int(lengths[i]))
        ids[at : at + width] = i
        sizes[at : at + width] = lengths[i]
    return limit, ids, sizes


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit words, bit at which each id starts and the end)."""
    size = lengths[ids].astype(np.uint64)
    at = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(size, out=at[1:])
    words = np.zeros(int(at[-1] >> np.uint64(5)) + 2, dtype=np.uint64)
    if len(ids):
        word = (at[:-1] >> np.uint64(5)).astype(np.int64)
        shift = np.uint64(64) - size - (at[:-1] & np.uint64(31))
        value = codes[ids] << shift
        new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        value = np.bitwise_or.reduceat(value, new)
        words[word[new]] |= value >> np.uint64(32)
        words[word[new] + 1] |= value & np.uint64(0xFFFFFFFF)
    return words.astype(np.uint32), at


def pack_file(ids: np.ndarray, doc_sizes: list[int], codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK, names: bytes = b"") -> bytes:
    """The bytes of one file. Blocks are coded in groups, so that what is in memory beside the ids is bounded."""
    out, starts, bit = io.BytesIO(), [], 0
    group = 64 * block
    carried, free = 0, 0  # bits of the last word so far
    for s in range(0, len(ids), group):
        words, at = write_bits(ids[s : s + group], codes, lengths)
        starts.append(at[:-1:block] + np.uint64(bit))
        used = int(at[-1])
        bits = np.zeros(len(words) + 1, dtype=np.uint64)
        bits[:-1] = words
        if free:
            moved = bits >> np.uint64(free)
            moved[1:] |= (bits[:-1] << np.uint64(32 - free)) & np.uint64(0xFFFFFFFF)
            moved[0] |= np.uint64(carried)
            bits = moved
        whole, free = divmod(free + used, 32)
        out.write(bits[:whole].astype(">u4").tobytes())
        carried = int(bits[whole]) if free else 0
        bit += used
    out.write(np.array([carried, 0, 0], dtype=">u4").tobytes())  # a reader may look beyond the end
    head = json.dumps({"block": block, "docs": len(doc_sizes), "ids": len(ids), "names": len(names)}).encode()
    index = np.concatenate(starts) if starts else np.zeros(0, dtype=np.uint64)
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, names, np.array(doc_sizes, dtype="<u4").tobytes(), index.astype("<u8").tobytes(), out.getvalue()])


def as_names(column) -> bytes:
    """An Arrow array as the bytes of a stream."""
    import pyarrow as pa

    out = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([column], names=["id"])
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def header(raw: bytes) -> tuple[dict, int]:
    """(the header, where it ends)."""
    if raw[:4] != MAGIC:
        raise ValueError("not a file of ids")
    n = int.from_bytes(raw[4:8], "little")
    return json.loads(raw[8 : 8 + n]), 8 + n


def document_names(raw: bytes):
    """The names of a file's documents, as an Arrow array."""
    import pyarrow as pa

    head, at = header(raw)
    return pa.ipc.open_stream(raw[at : at + head["names"]]).read_all().column(0).combine_chunks()


def unpack_file(raw: bytes, table: tuple[int, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document)."""
    head, at = header(raw)
    at += head["names"]
    sizes = np.frombuffer(raw, "<u4", head["docs"], at)
    at += 4 * head["docs"]
    blocks = -(-head["ids"] // head["block"])
    starts = np.frombuffer(raw, "<u8", blocks, at).astype(np.int64)
    words = np.frombuffer(raw, ">u4", -1, at + 8 * blocks).astype(np.uint64)
    # A block may be read beyond its end, by what its steps can take at most; such ids are cut off below.
    limit, by_bits, length = table
    words = np.concatenate([words, np.zeros(head["block"] * limit // 32 + 2, np.uint64)])
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    packed = (by_bits.astype(np.uint32) << np.uint32(5)) | length
    top, low = np.int64(64 - limit), np.int64(31)
    steps = min(head["block"], head["ids"])
    out = np.empty((steps, blocks), dtype=np.uint32)
    pos = starts.copy()
    for k in range(steps):
        look = pairs[pos >> 5]
        look >>= (top - (pos & low)).view(np.uint64)
        got = packed[look & np.uint64((1 << limit) - 1)]
        out[k] = got
        pos += got & np.uint32(31)
    out >>= np.uint32(5)
    return out.T.reshape(-1)[: head["ids"]] if blocks else np.zeros(0, np.uint32), sizes


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def put(path: str, data: bytes) -> None:
    """Write under a temporary name, then rename: a reader sees a whole file or none, and a repeated task writes the same."""
    fs, to = _filesystem(path)
    temp = f"{to}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as f:
        f.write(data)
    fs.move(temp, to)


def get(path: str) -> bytes:
    fs, at = _filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def count_ids(coded: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in all documents; a number for each id of the vocabulary comes to the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for _, raw in slices(batch.column(0)):
                got = np.bincount(np.frombuffer(b"".join(raw), kind))
                if len(got) > len(total):
                    total = np.r_[total, np.zeros(len(got) - len(total), np.int64)]
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def ordered_ids(docs: DataFrame, tokenizer: str, kind: str, path: str) -> DataFrame:
    """part, at (the row's place in its part), id, ids of all documents in ascending order of id over the parts: a
    written table, so that texts are encoded once though codes need the counts of all ids first."""
    spark = docs.sparkSession
    source = docs.withColumn("tie", row_hash(docs)).repartitionByRange(partitions(spark), "id", "tie").sortWithinPartitions("id", "tie").select(F.spark_partition_id().alias("part"), "id", "text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), docs.schema["id"], T.StructField("ids", T.BinaryType())])

    def encode(batches):
        import pyarrow as pa

        enc, seen = encoder(tokenizer, MORE_WORDS).encode, 0
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                raw = [x + end for x in enc(texts)]
                if kind != "<u4":
                    raw = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(range(seen, seen + len(texts)), pa.int64()), batch.column(1).slice(at, len(texts)), pa.array(raw, pa.binary())], names=schema.names)
                seen += len(texts)

    source.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_ids(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents, each followed by END_ID, in ascending order of id_col (nulls first, ties by
    a hash of the row), to files below path, and return the manifest: file, part, at, first_id, n_ids, first_start.

    A null text counts as empty: END_ID alone. Texts of any length are coded whole; other columns are not written,
    whatever their names. An empty table has a manifest without rows. The manifest is written last; files that it
    does not name are left-overs of lost tasks."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(c(id_col).alias("id"), F.coalesce(c(text_col), F.lit("")).alias("text"))
    kind = "<u2" if encoder(tokenizer).tok.get_vocab_size() <= 1 << 16 else "<u4"
    ids_path = scratch(spark, "ordered-ids")
    coded = ordered_ids(source, tokenizer, kind, ids_path)
    lengths = code_lengths(count_ids(coded, kind))
    codes = canonical(lengths)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, lengths=lengths)
    put_from_driver(spark, f"{path}/codes.npz", buffer.getvalue())

    def write(batches):
        import pyarrow as pa

        held, sizes, doc_ids, total, part, begin, due = [], [], [], 0, None, 0, None
        id_type = None

        def flush():
            nonlocal held, sizes, doc_ids, total
            ids = np.frombuffer(b"".join(held), kind)
            name = f"{path}/part-{part:06d}-{begin:012d}.hid"
            put(name, pack_file(ids, sizes, codes, lengths, names=as_names(pa.array(doc_ids, id_type))))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([begin], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array(doc_ids[:1], id_type)], names=["file", "part", "at", "n_ids", "first_id"])
            held, sizes, doc_ids, total = [], [], [], 0
            return row

        for batch in batches:
            id_type = batch.column(2).type
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for p, at, ident, raw in rows:
                if sizes and ((p, at) != due or total >= IDS_A_FILE):
                    yield flush()
                if not sizes:
                    part, begin = p, at
                held.append(raw)
                sizes.append(len(raw) // np.dtype(kind).itemsize)
                doc_ids.append(ident)
                total += sizes[-1]
                due = (p, at + 1)
        if sizes:
            yield flush()

    id_type_ddl = source.schema["id"].dataType.simpleString()
    manifest = saved(coded.mapInArrow(write, f"file string, part int, at long, n_ids long, first_id {id_type_ddl}"), "manifest", f"{path}/manifest")
    discard(spark, ids_path)
    # Ids before each file: those of earlier parts (a number a part), then those before it in its own.
    start, rows = 0, []
    for r in sorted(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect(), key=lambda r: r["part"]):
        rows.append((r["part"], start))
        start += r["n"]
    before = spark.createDataFrame(rows, "part int, part_start long")
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("first_start", F.col("part_start") + F.col("inside")).drop("inside", "part_start")


def put_from_driver(spark, path: str, data: bytes) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    out.write(data)
    out.close()


def read_ids(manifest: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document from the files: id_col, start (ids of all documents before it), n_tokens, ids_crc32 (and ids).

    The manifest says which files count and at which id each begins; documents' ids and codes are in the files. A
    null id is null again, a document of an empty text has END_ID alone, an empty manifest gives an empty result."""
    spark = manifest.sparkSession
    id_type = manifest.schema["first_id"].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def read(batches):
        import pyarrow as pa

        table = None
        for batch in batches:
            for k in range(batch.num_rows):
                if table is None:
                    table = tables(np.load(io.BytesIO(get(f"{path}/codes.npz")))["lengths"])
                file = get(batch.column(0)[k].as_py())
                ids, sizes = unpack_file(file, table)
                names = document_names(file)
                del file
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                for s in range(0, len(sizes), 2048):
                    own = [raw[4 * a : 4 * b] for a, b in zip(starts[s : s + 2048].tolist(), ends[s : s + 2048].tolist())]
                    out = [names.slice(s, 2048), pa.array(starts[s : s + 2048] + batch.column(1)[k].as_py()), pa.array(sizes[s : s + 2048].astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                    if with_ids:
                        out.append(pa.array(own, pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return manifest.select("file", "first_start").repartition(partitions(spark)).mapInArrow(read, T.StructType(fields))


def op9_huffman_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = scratch(spark, "ids")
    return read_ids(write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), path), path)
