"""Operator 8: WARC archives with a Merkle fixity audit.

Pages become WARC/1.1 response records. Records are numbered from 0 without gaps in the order of page number, url and
hash; FILE_RECORDS neighbours make an archive file, in which they stand one after the other. A tree holds the hash of
every record, of every range of FAN neighbouring records in offset order, of every file, and of ranges of FILE_FAN files up
to one root. The hash of a node covers its children's hashes and their offset ranges from the node's own start, so a record
that moves, or grows at another's cost, changes the nodes above it, and one that only moves with its range does not. Two
replicas are compared from the root; only children of nodes that differ are read on, so an audit of equal replicas reads one
row of each, and one of damaged replicas follows the damage.

Archive files are scanned record by record. Bytes that are no record, records whose stated length leads nowhere, cut files
and broken gzip members are reported as ranges of their own, and the scan goes on at the next record. Offsets are those in
the file (for gzip of the record's member, with its place inside it) and those in the unpacked file, which the tree binds.

Everything is DataFrame functions but the scan, which has to parse files. No group is larger than a file or a fan,
whatever the page numbers: rows are numbered by sorted ranges and the ranges' counts (one row a partition). A level of a
tree is one aggregation with at most FAN (or FILE_FAN) hashes a group. Hashes are made where the pages lie, so the audit
moves no page.

Defined cases: null urls and pages count as empty; null page numbers come first; rows with equal page numbers are separate
records; pages of any length are whole records; an empty table gives an empty tree, and equal replicas an empty report; other
columns are not read. A scan holds one archive file at a time, of at most the 2 GB that Spark's binary reader takes; damage in
files is reported and never ends a scan.
"""

from __future__ import annotations

import io
import re
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, materialize, shuffle_partitions

FILE_RECORDS, FAN, FILE_FAN = 256, 16, 1024
DATE = "2024-01-01T00:00:00Z"
_IN_PARTITION = (1 << 33) - 1


def record_text(number: Column, url: Column, html: Column) -> Column:
    """A whole response record as text."""
    name = F.md5(F.concat(F.coalesce(number.cast("string"), F.lit("")), F.lit(" "), url))
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html)
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, http, F.lit("\r\n\r\n"))


def to_records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, record (the whole record as text)."""
    url, html = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    number = F.col(id_col).cast("long")
    return df.select(number.alias("page_id"), url.alias("url"), record_text(number, url, html).alias("record"))


def record_hash(record: Column) -> Column:
    return F.sha2(F.encode(record, "utf-8"), 256)


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """df with file and pos: rows numbered from 0 in the given order, FILE_RECORDS to a file. Nothing is put in one task:
    ranges are sorted apart, and each range starts where the counts of those before it end."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*order, "__tie")]  # the tie lets equal rows fall into several ranges
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).drop("__tie")
    placed = materialize(ranged.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__m", 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    first, offsets = 0, []
    for p in range(max(counts, default=-1) + 1):
        offsets.append(first)
        first += counts.get(p, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), part + 1)
    number = base + F.col("__m").bitwiseAND(F.lit(_IN_PARTITION))
    return placed.withColumn("file", F.floor(number / FILE_RECORDS).cast("long")).withColumn("pos", F.pmod(number, F.lit(FILE_RECORDS)).cast("long")).drop("__m")


def lay_out(records: DataFrame) -> DataFrame:
    """An archive: page_id, url, record, file, pos."""
    return number_rows(records.withColumn("__h", record_hash(F.col("record"))), ["page_id", "url", "__h"]).drop("__h")


def leaves(archive: DataFrame, size: Column | None = None, digest: Column | None = None) -> DataFrame:
    """page_id, file, pos, start, stop (byte offsets in the file), hash of every record of an archive."""
    size = F.octet_length("record") if size is None else size
    digest = record_hash(F.col("record")) if digest is None else digest
    hashed = archive.select("page_id", "file", "pos", size.cast("long").alias("__n"), digest.alias("hash"))
    stop = F.sum("__n").over(W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return hashed.select("page_id", "file", "pos", (stop - F.col("__n")).alias("start"), stop.alias("stop"), "hash")


def _parents(level: DataFrame, keys: list, fan_key: Column) -> DataFrame:
    """One row a group of neighbours; at most a fan of hashes is gathered for each."""
    grouped = level.withColumn("__up", fan_key).groupBy(*keys, "__up").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sort_array(F.collect_list(F.struct("file", "pos", F.col("start").alias("a"), F.col("stop").alias("b"), "hash"))).alias("__parts"))
    child = F.transform("__parts", lambda x: F.concat_ws(":", (x["a"] - F.col("start")).cast("string"), (x["b"] - F.col("start")).cast("string"), x["hash"]))
    return grouped.withColumn("hash", F.sha2(F.concat(F.lit("node "), F.array_join(child, " ")), 256)).drop("__parts")


def build_tree(leaf_rows: DataFrame, fan: int = FAN, file_fan: int = FILE_FAN) -> list[DataFrame]:
    """Levels of the tree from the root down: each has file, pos, start, stop, hash, and up_file, up (its parent's key); the
    last has page_id too.

    Inside a file nodes are (file, pos); a file's root is pos 0 of the level above its ranges; above files, `file` is a
    number of a range of files."""
    zero = F.lit(0).cast("long")
    levels = [leaf_rows.withColumn("up", F.floor(F.col("pos") / fan).cast("long")).withColumn("up_file", F.col("file"))]
    ranges = materialize(_parents(leaf_rows, ["file"], F.floor(F.col("pos") / fan).cast("long")).withColumnRenamed("__up", "pos"), "merkle")
    levels.append(ranges.withColumn("up", zero).withColumn("up_file", F.col("file")))
    files = materialize(_parents(ranges, ["file"], zero).withColumnRenamed("__up", "pos"), "merkle")
    while True:
        up = F.floor(F.col("file") / file_fan).cast("long")
        levels.append(files.withColumn("up", zero).withColumn("up_file", up))
        if files.limit(2).count() < 2:
            return levels[::-1]
        files = materialize(_parents(files, [], up).withColumnRenamed("__up", "file").withColumn("pos", zero), "merkle")


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> tuple[DataFrame, list[int]]:
    """Leaves that differ (file, pos, start, stop, page_id, expected, actual, kind: changed, missing, extra, or moved for whole
    records at another offset), and how many node pairs were compared on each level from the root down. Trees of different
    height are compared from the lower one's root level on."""
    depth = min(len(primary), len(replica))
    suspects, compared = None, []
    for i in range(depth):
        mine, other = primary[len(primary) - depth + i], replica[len(replica) - depth + i]
        if suspects is not None:
            mine = mine.join(suspects, [mine.up_file == suspects.s_file, mine.up == suspects.s_pos], "left_semi")
            other = other.join(suspects, [other.up_file == suspects.s_file, other.up == suspects.s_pos], "left_semi")
        extra = ["page_id"] if i == depth - 1 else []
        a = mine.select("file", "pos", *[F.col(c).alias(f"a_{c}") for c in ("start", "stop", "hash", *extra)])
        b = other.select("file", "pos", *[F.col(c).alias(f"b_{c}") for c in ("start", "stop", "hash", *extra)])
        pairs = materialize(a.join(b, ["file", "pos"], "full_outer"), "audit")
        compared.append(pairs.count())
        same = F.col("a_hash").eqNullSafe(F.col("b_hash"))
        if i == depth - 1:  # leaves; above them a node's hash covers its children's places
            same = same & F.col("a_start").eqNullSafe(F.col("b_start"))
        differ = pairs.filter(~same)
        suspects = differ.select(F.col("file").alias("s_file"), F.col("pos").alias("s_pos"))
    kind = F.when(F.col("a_hash").isNull(), "extra").when(F.col("b_hash").isNull(), "missing").when(F.col("a_hash") == F.col("b_hash"), "moved").otherwise("changed")
    found = differ.select("file", "pos", F.coalesce("a_start", "b_start").alias("start"), F.coalesce("a_stop", "b_stop").alias("stop"), F.coalesce("a_page_id", "b_page_id").alias("page_id"), F.col("a_hash").alias("expected"), F.col("b_hash").alias("actual"), kind.alias("kind"))
    return found, compared


def write_warc(archive: DataFrame, path: str, compression: str = "none") -> None:
    """Write an archive to WARC files (with compression="gzip" as one gzip member each), one folder a file number, in page
    order."""
    rows = archive.withColumn("value", F.expr("left(record, length(record) - 2)"))
    rows.repartition("file").sortWithinPartitions("file", "pos").select("file", "value").write.partitionBy("file").option("lineSep", "\r\n").option("compression", compression).text(path)


_MAGIC = re.compile(rb"WARC/\d\.\d\r\n")
_NEXT = re.compile(rb"\r\n\r\n(?=WARC/\d\.\d\r\n)")


def parse_records(data: bytes):
    """(start, stop, status, headers, content) of all of data in order. status: ok; damaged for a record whose headers or length
    don't hold, which then ends where the next record begins; stray for bytes between records."""
    at, n = 0, len(data)
    while at < n:
        if not _MAGIC.match(data, at):
            found = _MAGIC.search(data, at)
            stop = found.start() if found else n
            yield at, stop, "stray", {}, data[at:stop]
            at = stop
            continue
        head = data.find(b"\r\n\r\n", at)
        body = head + 4 if head >= 0 else n
        lines = data[at:body].decode("utf-8", errors="replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines) if colon}
        length = headers.get("content-length", "")
        end = body + int(length) if head >= 0 and length.isascii() and length.isdigit() and len(length) < 16 else -1
        if end >= 0 and data[end : end + 4] == b"\r\n\r\n":
            yield at, end + 4, "ok", headers, data[body:end]
            at = end + 4
        else:
            found = _NEXT.search(data, at)
            stop = found.end() if found else n
            yield at, stop, "damaged", headers, data[body:stop]
            at = stop


def _members(data: bytes):
    """(offset, length, unpacked bytes, whole) of each gzip member of data, or of all of it if it isn't gzip. Bytes that are no
    whole member come with what could be unpacked of them, up to the next place where a member unpacks."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data, True
        return
    at = 0
    while at < len(data):
        unpack, out, whole = zlib.decompressobj(31), b"", False
        try:
            view = memoryview(data)[at:]
            parts, step = [], 1 << 20
            for i in range(0, len(view), step):
                parts.append(unpack.decompress(view[i : i + step]))
                if unpack.eof:
                    whole = True
                    break
        except zlib.error:
            pass
        out = b"".join(parts)
        if whole:
            stop = min(at + i + step, len(data)) - len(unpack.unused_data)
        else:
            stop = data.find(b"\x1f\x8b\x08", at + 1)
            stop = len(data) if stop < 0 else stop
        yield at, stop - at, out, whole
        at = stop


def parse_warc(data: bytes):
    """All ranges of an archive file as dictionaries: pos (number of the record, none for stray bytes), offset and length in the
    file (of the gzip member that holds it), inner (place in the unpacked member), start and stop in the unpacked file, status
    (as parse_records; broken for a gzip member that doesn't unpack), headers, content, sha256 of the whole range."""
    pos, base = 0, 0
    for offset, length, unpacked, whole in _members(data):
        plain = whole and len(unpacked) == length and unpacked[:5] == data[offset : offset + 5]
        if not whole:
            yield {"pos": None, "offset": offset, "length": length, "inner": 0, "start": base, "stop": base, "status": "broken", "headers": {}, "content": b"", "sha256": sha256(data[offset : offset + length]).hexdigest()}
        for start, stop, status, headers, content in parse_records(unpacked):
            place = {"offset": offset + start, "length": stop - start, "inner": 0} if plain else {"offset": offset, "length": length, "inner": start}
            yield {"pos": None if status == "stray" else pos, **place, "start": base + start, "stop": base + stop, "status": status, "headers": headers, "content": content, "sha256": sha256(unpacked[start:stop]).hexdigest()}
            pos += status != "stray"
        base += len(unpacked)


_SCAN = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("pos", "offset", "length", "inner", "start", "stop")), *((n, pa.string()) for n in ("status", "type", "url", "sha256", "html"))])


def scan_warc(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Every range of the archive files below path, damage included: path, pos, offset, length, inner, start, stop, status, type,
    url, sha256, and with `content` the page (html) of whole response records."""
    bounded_batches(spark, rows=16)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def page(data: bytes) -> str:
        stream = io.BytesIO(data)
        while stream.readline().strip():
            pass
        return stream.read().decode("utf-8", errors="replace")

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for r in parse_warc(data.as_py()):
                    kind = r["headers"].get("warc-type")
                    html = page(r["content"]) if content and r["status"] == "ok" and kind == "response" else None
                    rows.append({**r, "path": name.as_py(), "type": kind, "url": r["headers"].get("warc-target-uri"), "html": html})
                    held += len(html or "")
                    if len(rows) >= 4096 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_SCAN)

    return files.mapInArrow(run, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in _SCAN))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, length, url, html, status of the response records of archive files; every folder below path is read. Ranges
    that can't be read have status damaged, stray or broken and a null html."""
    scanned = scan_warc(spark, path, content=True)
    return scanned.filter((F.col("status") != "ok") | (F.col("type") == "response")).select("path", "offset", "length", "url", "html", "status")


def archive_leaves(spark: SparkSession, path: str, number: str = r"file=(\d+)/") -> DataFrame:
    """Leaves (page_id, null here; file, pos, start, stop, hash) of written archive files; number: a pattern whose group is the
    file's number in its path. Stray bytes and broken members show in the places of the records after them."""
    records = scan_warc(spark, path).filter("pos is not null")
    return records.select(F.lit(None).cast("long").alias("page_id"), F.regexp_extract("path", number, 1).cast("long").alias("file"), "pos", "start", "stop", F.col("sha256").alias("hash"))


def audit_archives(spark: SparkSession, primary: str, replica: str) -> tuple[DataFrame, list[int]]:
    """audit of two folders of archive files."""
    sides = [build_tree(materialize(archive_leaves(spark, path), "leaves")) for path in (primary, replica)]
    return audit(*sides)


def damaged_text(page_id: Column, record: Column) -> Column:
    """Stated damage, for drills: records of pages with number % 97 = 13 have their middle character overwritten, those with
    number % 211 = 5 lose their last 7 characters, and those with number % 401 = 7 are missing (null)."""
    middle = F.floor(F.length(record) / 2).cast("int")
    flipped = F.concat(F.left(record, middle - 1), F.lit("\x01"), F.substring(record, middle + 1, F.length(record)))
    lost = F.when(page_id % 401 == 7, F.lit(None).cast("string"))
    return lost.when(page_id % 97 == 13, flipped).when(page_id % 211 == 5, F.left(record, F.length(record) - 7)).otherwise(record)


def damaged_copy(archive: DataFrame) -> DataFrame:
    """A replica of an archive with damaged_text's damage."""
    return archive.withColumn("record", damaged_text(F.col("page_id"), F.col("record"))).filter("record is not null")


def fixity_report(df: DataFrame) -> DataFrame:
    """A drill over all pages: one row a page with page_id, file, start, stop, record_sha256, replica_sha256, damaged, as the
    audit of df's archive against its damaged copy finds it. For replicas that lie somewhere: lay_out, leaves, audit."""
    records = to_records(df)
    copy = damaged_text(F.col("page_id"), F.col("record"))
    hashed = records.select("page_id", "url", F.octet_length("record").alias("n"), record_hash(F.col("record")).alias("h"), F.octet_length(copy).alias("c_n"), record_hash(copy).alias("c_h"))
    layout = number_rows(hashed, ["page_id", "url", "h"])
    mine = materialize(leaves(layout, F.col("n"), F.col("h")), "leaves")
    other = materialize(leaves(layout.filter("c_h is not null"), F.col("c_n"), F.col("c_h")), "leaves")
    found, _ = audit(build_tree(mine), build_tree(other))
    marks = found.filter("kind in ('changed', 'missing')").select("file", "pos", "actual", F.lit(True).alias("__bad"))
    joined = mine.join(marks, ["file", "pos"], "left")
    bad = F.coalesce("__bad", F.lit(False))
    return joined.select("page_id", "file", "start", "stop", F.col("hash").alias("record_sha256"), F.when(bad, F.col("actual")).otherwise(F.col("hash")).alias("replica_sha256"), bad.alias("damaged"))
