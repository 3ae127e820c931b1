"""A deterministic sharded WARC writer, and a reader.

Records are sorted by id and digest and cut into ranges at rows whose numbers in that order follow from the
data alone (an exact numbering, no sampled splitters), so the same rows make the same ranges whatever the
partitions; each range goes to files that are rolled by compressed size. Headers and digests are made anew from the payload, record ids follow from the content, times are a
parameter, and compression has no clock in it, so the same input gives the same bytes. A file is written
under a temporary name and renamed; the manifest, written last, names the files that count."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import c, discard, free_names, global_row_number, partitions, saved, scratch, small_batches
from .huffman_ids import get, put

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 16_000_000
#: Payload of a range in the mean, and ranges at most: more rows make larger ranges, of more files.
RANGE_BYTES, MOST_RANGES = 32_000_000, 1 << 16
LEAST_REVISIT = 1000
LEVEL = 6
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodestone:warc")


def record_id(ident: str, digest: str, nth: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{ident}|{digest}|{nth}')}>"


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


#: What a header cannot hold as it is; such an address is written with these (and %) as %XX, and a header says so.
UNSAFE = re.compile(r"[\x00-\x1f\x7f]|^\s|\s$")
ESCAPED = "X-Target-URI-Escaped"


def address(url: str) -> list[tuple[str, str]]:
    """The headers of an address, from which written() has it back exactly."""
    if not UNSAFE.search(url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", re.sub(r"[\x00-\x1f\x7f%]|^\s+|\s+$", lambda m: quote(m[0], safe=""), url)), (ESCAPED, "1")]


def written(headers: dict[str, str]) -> str:
    url = headers["WARC-Target-URI"]
    return unquote(url) if ESCAPED in headers else url


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def info_record(name: str, date: str) -> bytes:
    block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    return member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, "info")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def page_record(ident: str, nth: int, url: str, payload: bytes, digest: str, keeper: str | None, date: str) -> bytes:
    """A response, or with keeper (the id of the response of equal payload) a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    headers = [
        ("WARC-Type", "response" if keeper is None else "revisit"), ("WARC-Record-ID", record_id(ident, digest, nth)), ("WARC-Date", date), *address(url),
        ("WARC-Payload-Digest", base32(digest)), ("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("X-Page-Id", ident),
    ]
    if keeper is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(keeper, digest)), ("X-Refers-To-Page-Id", keeper)]
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT, roll_bytes: int = ROLL_BYTES, date: str = DATE, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write a record for each row to .warc.gz files below path; returns the manifest (file, records, bytes).

    Of rows with equal payloads of at least least_revisit bytes, the one with the largest id is a response and
    the others revisit it (of rows with equal payload and id too, the first is the response). A null html is an
    empty payload, a null url an empty address; null ids sort first, and are written as `null`. Other columns
    are not written, whatever their names. Payloads of any length are one record. An empty table gives an empty
    manifest. Equal rows give equal files (names and bytes), in any order and any partitions."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.encode(F.coalesce(c(html_col), F.lit("")), "utf-8")
    rows = pages.select(c(id_col).alias("id"), F.coalesce(c(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html")).withColumn("digest", F.sha1("html"))
    keys_path, rule_path = scratch(spark, "records"), scratch(spark, "revisits")
    slim = saved(rows.select("id", "digest", "url", F.octet_length("html").cast("long").alias("size")), "records", keys_path)
    long = slim.where(F.col("size") >= least_revisit).select("id", "digest")
    groups = long.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rules = saved(long.join(groups, "digest").distinct(), "revisits", rule_path)
    both = rules.select("id", "digest", F.lit(0).alias("kind"), "keeper", F.lit("").alias("url"), F.lit(None).cast("binary").alias("html")).unionByName(
        rows.select("id", "digest", F.lit(1).alias("kind"), F.lit(None).cast(rules.schema["keeper"].dataType).alias("keeper"), "url", "html")
    )
    placed = in_ranges(both, slim, range_bytes)
    ordered = placed.repartitionByRange(partitions(spark), "part").sortWithinPartitions("part", "id", "digest", "kind", "url").select("part", "id", "digest", "kind", "keeper", "url", "html")

    def write(batches):
        import pyarrow as pa

        held, size, records, seq, part, name = [], 0, 0, 0, 0, ""
        rule, last, nth = None, None, 0

        def flush():
            nonlocal held, size, records, seq
            put(f"{path}/{name}", b"".join(held))
            row = pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])
            held, size, records, seq = [], 0, 0, seq + 1
            return row

        for batch in batches:
            for k in range(batch.num_rows):
                of, ident, digest, kind, keeper = (batch.column(i)[k].as_py() for i in range(5))
                if of != part:
                    if held:
                        yield flush()
                    part, seq = of, 0
                if kind == 0:
                    rule = (ident, digest, keeper)
                    continue
                nth = nth + 1 if last == (ident, digest) else 0
                last = (ident, digest)
                to = None
                if rule is not None and rule[:2] == last and (rule[2] != ident or nth):
                    to = str(rule[2]) if rule[2] is not None else "null"
                url = batch.column(5)[k].as_py()
                if not held:
                    name = f"part-{part:06d}-{seq:05d}.warc.gz"
                    held.append(info_record(name, date))
                    size = len(held[0])
                held.append(page_record("null" if ident is None else str(ident), nth, url, batch.column(6)[k].as_py(), digest, to, date))
                size += len(held[-1])
                records += 1
                if size >= roll_bytes:
                    yield flush()
        if held:
            yield flush()

    manifest = saved(ordered.mapInArrow(write, "file string, records long, bytes long"), "manifest", f"{path}/manifest")
    discard(spark, rule_path)
    discard(spark, keys_path)
    return manifest


def in_ranges(rows: DataFrame, slim: DataFrame, range_bytes: int) -> DataFrame:
    """rows with part, the number of their range by (id, digest): a range begins at every so many rows of slim, and
    how many follows from its sizes. The range of a row is found by binary search in the keys that begin one."""
    spark = rows.sparkSession
    total = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    ranges = min(MOST_RANGES, max(1, -(-(total.size or 0) // range_bytes)))
    each = max(1, -(-total.n // ranges))
    table, key = free_names(rows, "_cuts", "_key")
    first = global_row_number(slim, ["id", "digest", "url"], "nth").where((F.col("nth") % each == 0) & (F.col("nth") > 0))
    cuts = saved(first.agg(F.coalesce(F.sort_array(F.collect_set(F.struct("id", "digest"))), F.array().cast(f"array<{slim.select(F.struct('id', 'digest').alias('k')).schema['k'].dataType.simpleString()}>")).alias(table)), "cuts")
    middle = "CAST((s.lo + s.hi) DIV 2 AS INT)"
    step = f"if(s.lo >= s.hi, s, if({table}[{middle}] <= {key}, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    at = f"aggregate(sequence(0, {MOST_RANGES.bit_length()}), named_struct('lo', 0, 'hi', size({table})), (s, k) -> {step}, s -> s.lo)"
    return rows.withColumn(table, cuts.scalar()).withColumn(key, F.struct("id", "digest")).withColumn("part", F.expr(at)).drop(table, key)


def records(raw: bytes, chunk: int = 1 << 16):
    """(headers, block) of each record of a file of gzip members."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(raw):
                raise ValueError("a record is cut off")
            piece = view[at : at + chunk]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        data = b"".join(parts)
        cut = data.index(b"\r\n\r\n")
        lines = data[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        n = int(headers["Content-Length"])
        yield headers, data[cut + 4 : cut + 4 + n]


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's files: page_id, url, record_type, payload_bytes, payload_digest, refers_to (ids
    as text; and payload, null for revisits). Digests of responses are computed and compared with the headers. An
    id written as `null` is null again, an empty payload or address is empty, and an empty manifest gives an empty
    result."""
    fields = [T.StructField(n, T.StringType()) for n in ("page_id", "url", "record_type")] + [T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType())]
    if with_payload:
        fields.append(T.StructField("payload", T.BinaryType()))

    def read(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for i, f in enumerate(fields)], names=[f.name for f in fields])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for headers, block in records(get(name)):
                    kind = headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    cut = block.index(b"\r\n\r\n")
                    payload = block[cut + 4 :]
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    told = next(int(x.split(b":")[1]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    ident, to = headers["X-Page-Id"], headers.get("X-Refers-To-Page-Id")
                    rows.append((None if ident == "null" else ident, written(headers), kind, told, digest, None if to == "null" else to, payload if kind == "response" else None))
                    size += len(payload)
                    if len(rows) >= 1024 or size >= 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return manifest.select("file").repartition(partitions(manifest.sparkSession)).mapInArrow(read, T.StructType(fields))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    back = read_warc(write_warc(pages, scratch(spark, "warc")))
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT h, max(page_id) AS m FROM p WHERE strlen(h) >= {LEAST_REVISIT} GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN g.m IS NOT NULL AND g.m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.m IS NOT NULL AND g.m <> p.page_id THEN g.m END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h
"""
