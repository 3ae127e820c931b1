import gzip
import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import warc as w
from lodestone.llm.common import scratch
from lodestone.llm.huffman_ids import get
from lodestone.llm.queries import ORACLE_SQL, QUERIES

from .helpers import TRICKY, tricky


def brute(rows, least):
    """(id, bytes, digest, type, refers_to) of (id, html); of rows equal in both, the first is the response."""
    groups = defaultdict(list)
    for i, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            groups[raw].append(i)
    out, seen = [], set()
    for i, html in rows:
        raw = (html or "").encode()
        ids = [x for x in groups.get(raw, []) if x is not None]
        keeper = max(ids) if ids else None
        response = raw not in groups or (i == keeper and raw not in seen)
        if response and raw in groups:
            seen.add(raw)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if response else "revisit", None if response else keeper))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,roll", [(0, 10**9), (10, 400), (1000, 10**9)])
def test_warc_tricky(spark, least, roll):
    pages = tricky(spark, "page_id", "html").withColumn("url", F.concat(F.lit("http://x/\r\n "), F.col("page_id").cast("string")))
    manifest = w.write_warc(pages, scratch(spark, "t"), least_revisit=least, roll_bytes=roll)
    got = [(None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in w.read_warc(manifest).collect()]
    assert sorted(got, key=repr) == brute(TRICKY, least)
    payloads = {r.payload_digest: bytes(r.payload) for r in w.read_warc(manifest, with_payload=True).where("record_type = 'response'").collect()}
    assert all(hashlib.sha1(p).hexdigest() == d for d, p in payloads.items())
    for r in manifest.collect():
        data = gzip.decompress(get(r.file))
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_is_deterministic(spark):
    pages = tricky(spark, "page_id", "html").withColumn("url", F.lit("u"))
    files = []
    for n in (3, 5):
        manifest = w.write_warc(pages.repartition(n), scratch(spark, "t"), least_revisit=10, roll_bytes=500)
        files.append({r.file.rsplit("/", 1)[1]: hashlib.sha1(get(r.file)).hexdigest() for r in manifest.collect()})
    assert files[0] == files[1] and len(files[0]) > 1


def test_warc_is_deterministic_beyond_samples(spark):
    """60 000 rows, more than range partitioning samples, in other orders and partitions: equal names and bytes."""
    pages = spark.range(60_000).select((F.xxhash64("id") % 50_000).alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 7).alias("url"), F.repeat(F.hex(F.xxhash64(F.col("id") % 40_000)), 12).alias("html"))
    files = []
    for n, shuffled in ((8, "6"), (3, "11")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        try:
            manifest = w.write_warc(pages.repartition(n, F.rand(n)), scratch(spark, "t"), least_revisit=100, roll_bytes=300_000, range_bytes=2_000_000)
            files.append({r.file.rsplit("/", 1)[1]: (r.records, hashlib.sha1(get(r.file)).hexdigest()) for r in manifest.collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert files[0] == files[1] and len(files[0]) > 6 and sum(n for n, _ in files[0].values()) == 60_000


def test_addresses_come_back_whole(spark):
    urls = ["http://x/a  b", " lead", "trail\t", "a\r\nb: c", "100%25 \x00", "%41", "", "http://x/ü?q=1&r=: 2"]
    pages = spark.createDataFrame([(k, u, "payload") for k, u in enumerate(urls)], "page_id long, url string, html string")
    back = w.read_warc(w.write_warc(pages, scratch(spark, "t")))
    assert {int(r.page_id): r.url for r in back.collect()} == dict(enumerate(urls))


def test_warc_empty(spark):
    pages = tricky(spark, "page_id", "html").withColumn("url", F.lit("u")).limit(0)
    manifest = w.write_warc(pages, scratch(spark, "t"))
    assert manifest.count() == 0 and w.read_warc(manifest).count() == 0


def test_damage_is_found(spark):
    raw = w.page_record("1", 0, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, w.DATE)
    with pytest.raises(ValueError):
        list(w.records(raw[:-3]))
    assert [b[-7:] for _, b in w.records(raw + raw)] == [b"payload"] * 2


def test_query_op5(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    got = sorted((tuple(r) for r in QUERIES["op5_warc"](spark, sf).collect()), key=repr)
    assert got == brute([tuple(r) for r in rows], 1000)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    assert sorted(con.execute(ORACLE_SQL["op5_warc"]).fetchall(), key=repr) == got
