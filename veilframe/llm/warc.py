"""WARC archives with a two-level capture index.

Level two are index lines sorted by reversed-host URL key, in compressed blocks; level one is a sparse
directory with the first and last key of each block.  A look-up sends each wanted key to the part of the directory
that covers it, binary-searches that, reads one block, binary-searches it, and reads just the record's range of the archive.

Pages are put in key order before they are written, so that the records of an index block lie side by
side and a scan over the index reads each archive front to back.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_folder, stage_table
from ._files import Appender, Ranges

#: captures in one compressed index block
BLOCK_LINES = 512
#: bytes after which a task starts another archive
ARCHIVE_BYTES = 256 << 20
_DATE = "1970-01-01T00:00:00Z"  # pages carry no date
_ENTRY = "page_id string, key string, file string, offset bigint, length bigint"
_DIRECTORY = "shard bigint, first_key string, last_key string, file string, offset bigint, length bigint, captures bigint"
_RECORD = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


#: host, path and query of a URL
_URL = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\[\\]]*)(?![^/?#:])(?::[0-9]*)?([^?#]*)(\\?[^#]*)?"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: characters that would end a line or a field of the index
_ESCAPES = (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example)/a?b``. A null url has the empty key, what is no URL is its own."""
    key, found = url or "", re.match(_URL, url or "")
    if found:
        host = found[1].translate(str.maketrans(_UPPER, _LOWER)).rstrip(".").removeprefix("www.")
        key = ",".join(reversed(host.split("."))) + ")" + (found[2] or "/") + (found[3] or "")
    for c, escaped in _ESCAPES:
        key = key.replace(c, escaped)
    return key


def key_of(url: Column) -> Column:
    """``url_key`` as an expression."""
    part = lambda k: F.regexp_extract(url, _URL, k)
    host = F.regexp_replace(F.regexp_replace(F.translate(part(1), _UPPER, _LOWER), "\\.+$", ""), "^www\\.", "")
    path = F.when(part(2) == "", F.lit("/")).otherwise(part(2))
    key = F.when(url.rlike(_URL), F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path, part(3))).otherwise(F.coalesce(url, F.lit("")))
    for c, escaped in _ESCAPES:
        key = F.replace(key, F.lit(c), F.lit(escaped))
    return key


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _header(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit that keeps the HTTP head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of an uncompressed record; checks a payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        n, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    name = lambda k: fields[k][len("<urn:page:") : -1] if k in fields else None
    return name("WARC-Record-ID"), fields.get("WARC-Target-URI"), n, digest, kind, name("WARC-Refers-To")


def _rows(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    fields = [x.split() for x in kinds.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if t == "bigint" else pa.string()) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes archives and their index; returns the directory of the index.

    Of rows with equal payloads the one with the largest id is the response; rows with a smaller id are
    revisits of it.  A null payload is an empty one; a null id is smaller than any other and among nulls all
    are alike; repeated rows of the largest id are all responses.  Files go to ``folder`` (by default a new
    one in the session's shared folder) and stay there.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digests = stage_table(source.select("id", F.sha1(F.col("html").cast("binary")).alias("sha")), "digests")
    last = stage_table(digests.groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"), "responses")
    marked = source.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(last, "sha", "left")
    revisit = F.when(F.coalesce(F.col("id") < F.col("last"), F.col("last").isNotNull() & F.col("id").isNull()), F.col("last"))
    ordered = marked.select(F.col("id").cast("string").alias("id"), "url", "html", revisit.cast("string").alias("refers"), key_of(F.col("url")).alias("key"))
    ordered = ordered.repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def archive(batches):
        to = Appender(f"{folder}/archives", ".warc.gz", ARCHIVE_BYTES)
        for batch in batches:
            rows = []
            for page_id, url, html, refers, k in zip(*(c.to_pylist() for c in batch.columns)):
                at = to.add(_gzip(record_bytes("null" if page_id is None else page_id, url, html.encode("utf-8", "replace"), refers)))
                rows.append((page_id, k, *at))
            yield _rows(rows, _ENTRY)
        to.close()

    entries = stage_table(ordered.mapInArrow(archive, _ENTRY), "captures")

    def index(batches):
        to = Appender(f"{folder}/index", ".cdx.gz", ARCHIVE_BYTES)
        held: list[tuple] = []

        def block():
            lines = "".join("\t".join((k, f, str(o), str(n))) + "\n" for _, k, f, o, n in held)
            row = (TaskContext.get().partitionId(), held[0][1], held[-1][1], *to.add(_gzip(lines.encode())), len(held))
            held.clear()
            return _rows([row], _DIRECTORY)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    yield block()
        if held:
            yield block()
        to.close()

    in_order = entries.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stage_table(in_order.mapInArrow(index, _DIRECTORY), "directory")


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def _captures(ranges: Ranges, file: str, offset: int, length: int) -> list[tuple[str, str, int, int]]:
    lines = _gunzip(ranges.read(file, offset, length)).decode().split("\n")[:-1]
    return [(k, f, int(o), int(n)) for k, f, o, n in (x.split("\t") for x in lines)]


#: bytes of neighbouring records that are read at once
_READ_BYTES = 8 << 20


def _records(ranges: Ranges, captures: list[tuple[str, str, int, int]]):
    """Records of captures, neighbours in one read."""
    for name, of_file in groupby(sorted(captures, key=lambda c: c[1:]), key=lambda c: c[1]):
        run: list[tuple[int, int]] = []

        def read(run=run, name=name):
            start, end = run[0][0], run[-1][0] + run[-1][1]
            data = ranges.read(name, start, end - start)
            return [parse_record(_gunzip(data[o - start : o - start + n])) for o, n in run]

        for _, _, o, n in of_file:
            if run and (o != run[-1][0] + run[-1][1] or o + n - run[0][0] > _READ_BYTES):
                yield from read()
                run.clear()
            run.append((o, n))
        if run:
            yield from read()


def look_up(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """All captures of the wanted ``keys`` (a column ``key``, see ``key_of``): directory search, block search, range reads.

    The directory's shards, one for each task that wrote it, are known by their first and last keys; a binary search sends a key
    to the shards that cover it, where the shard's own directory rows come first and are held.
    """
    shards = directory.groupBy("shard").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    bounds = sorted((low, high, shard) for shard, low, high in shards.collect())  # a row for each task of the index
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]

    def assign(batches):
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                k = bisect_left(highs, key)
                while k < len(bounds) and lows[k] <= key:
                    rows.append((bounds[k][2], key))
                    k += 1
            yield _rows(rows, "shard bigint, key string")

    wanted = keys.select("key").distinct().mapInArrow(assign, "shard bigint, key string")
    wanted = wanted.select("shard", F.lit(1).alias("kind"), "key", *[F.lit(None).cast(t).alias(c) for c, t in (("last_key", "string"), ("file", "string"), ("offset", "bigint"), ("length", "bigint"))])
    blocks = directory.select("shard", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "file", "offset", "length")
    both = blocks.unionByName(wanted).repartition("shard").sortWithinPartitions("shard", "kind", "key", "last_key")

    def run(batches):
        index, data = Ranges(), Ranges()
        shard, rows, lasts, held, captures = None, [], [], None, []
        for batch in batches:
            found = []
            for number, kind, key, *block in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    shard, rows, lasts, held = number, [], [], None
                if kind == 0:
                    rows.append((key, *block[1:]))
                    lasts.append(block[0])
                    continue
                k = bisect_left(lasts, key)
                while k < len(rows) and rows[k][0] <= key:
                    if held != k:
                        held, captures = k, _captures(index, *rows[k][1:])
                    at = bisect_left(captures, (key,))
                    while at < len(captures) and captures[at][0] == key:
                        found.append(captures[at])
                        at += 1
                    k += 1
            out = []
            for record in _records(data, found):
                out.append(record)
                if len(out) == 256:
                    yield _rows(out, _RECORD)
                    out = []
            yield _rows(out, _RECORD)
        index.close()
        data.close()

    return both.mapInArrow(run, _RECORD)


def look_up_urls(directory: DataFrame, urls: list[str]) -> DataFrame:
    """``look_up`` of a stated list of URLs."""
    return look_up(directory, directory.sparkSession.createDataFrame([(url_key(u),) for u in urls], "key string"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = look_up(write_archives(pages), pages.select(key_of(F.col("url")).alias("key")))
    return found.select(
        F.when(F.col("page_id") != "null", F.col("page_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )
