"""WARC archives of one gzip member per record, written and read by index.

Pages are read twice: once for the digests of payloads that repeat, and once to make records, compress each and deal them over archive files.
A file's task writes its members one after the other and hands out the index: path, offset, length, url, digest, page_id. Rows of the index
name whole members, so readers seek to any record, and programs that know nothing of the index read a file from its start. Readers take
selected index rows file by file, sort them by offset, merge neighbouring byte ranges into one read each, and check every digest.

Each try of a writing task has a file of its own; only files of tries that ended stand in the index, so a lost executor leaves a file that nothing names.

Null payloads are empty; a null url is written as an empty target; repeated rows are records of their own. Of records with equal payloads the
one with the largest page_id is the response, others revisit it (repeated rows of that page_id are all responses). Null page_ids count as the smallest; an empty table gives an empty archive.
Payloads and urls are bytes here: what is not UTF-8 comes back as it was. A target with line ends is written with those escaped, and whole in a field of its own.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.base import saved
from marginalia.session import shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"
#: Bytes of payload per archive file, and the largest gap that is read through rather than skipped.
FILE_BYTES, GAP = 256 << 20, 64 << 10
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five hex digits of the sum are four base-32 digits."""
    hexed = F.sha1(payload.cast("binary"))
    parts = [F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    digit = lambda p, s: F.substr(F.lit(BASE32), F.shiftright(p, s).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[digit(p, s) for p in parts for s in (15, 10, 5, 0)])


def _rows(pages: DataFrame) -> DataFrame:
    raw = lambda c: F.coalesce(F.col(c).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", raw("url").alias("url"), raw("html").alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", base32_sha1(F.col("payload")))


def records(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Per page: payload, digest, type and what it refers to. Only digests travel to find equal payloads."""
    rows = _rows(pages)
    last = (
        rows.where(F.col("payload_bytes") >= at_least)
        .groupBy(F.col("payload_digest").alias("_digest"))
        .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    last = saved(last, "repeated-payloads")  # of known size: payloads are shuffled for this join only if it is large
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return (
        rows.join(last, F.col("payload_digest") == F.col("_digest"), "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_last")))
        .drop("_digest", "_last", "_n")
    )


def _member(page_id, url: bytes, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A record as one gzip member."""
    page = lambda x: b"<urn:page:%s>" % (b"null" if x is None else str(x).encode())
    body = b"" if revisit else payload
    lines = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + page(page_id),
        b"WARC-Target-URI: " + url.replace(b"\r", b"%0D").replace(b"\n", b"%0A"),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    if revisit:
        lines += [b"WARC-Refers-To: " + page(refers_to), b"WARC-Profile: " + _PROFILE]
    if b"\r" in url or b"\n" in url:
        lines.append(b"WARC-Target-Base64: " + base64.b64encode(url))
    lines += [b"WARC-Full-Length: %d" % len(payload), b"Content-Type: text/html", b"Content-Length: %d" % len(body)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + END + body + END) + packer.flush()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_digest", "refers_to", "record_type"]
    for batch in batches:
        made = [
            _member(p.as_py(), u.as_py(), x.as_py(), d.as_py(), r.as_py(), t.as_py() == "revisit") for p, u, x, d, r, t in zip(*[batch[c] for c in names])
        ]
        kept = ["file", "page_id", "url", "payload_digest", "record_type"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(made, pa.binary())], [*kept, "member"])


def write(pages: DataFrame, path: str | None = None, at_least: int = 0) -> DataFrame:
    """Write the archive; returns its index: path, offset, length, url, digest, page_id."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    uri = path if "://" in path else f"file://{path.removeprefix('file:')}"
    size = pages.agg(F.sum(F.octet_length("html")), F.count("*")).first()
    files = max(1, ((size[0] or 0) + 600 * size[1]) // FILE_BYTES + 1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["page_id", "payload_digest", "url", "record_type"]  # rows equal in these are equal records
    id_kind = pages.select("page_id").schema[0].dataType.simpleString()
    dealt = records(pages, at_least).withColumn("file", F.pmod(F.xxhash64("page_id", "payload_digest", "url"), F.lit(files)).cast("int"))
    made = dealt.mapInArrow(_members, f"file int, page_id {id_kind}, url binary, payload_digest string, record_type string, member binary")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, name, at = None, None, None, 0
        store, folder = fs.FileSystem.from_uri(uri)
        store.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                files, members = batch["file"].to_pylist(), batch["member"]
                paths, offsets, lengths = [], [], []
                for f, m in zip(files, members):
                    if f != own:
                        if out is not None:
                            out.close()
                        name, own, at = f"{uuid.uuid4().hex}.warc.gz", f, 0
                        out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    raw = m.as_py()
                    out.write(raw)
                    paths.append(f"{uri}/{name}")
                    offsets.append(at)
                    lengths.append(len(raw))
                    at += len(raw)
                made = [pa.array(paths, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch["url"], batch["payload_digest"], batch["page_id"]]
                yield pa.RecordBatch.from_arrays(made, ["path", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    ordered = made.repartition(files, "file").sortWithinPartitions("file", *order)
    index = ordered.mapInArrow(put, f"path string, offset bigint, length bigint, url binary, digest string, page_id {id_kind}")
    return saved(index.withColumn("url", F.col("url").cast("string")), "warc-index")


def _ranges(rows: list[tuple[int, int]], gap: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) merged into reads: (from, to, members)."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in sorted(rows):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= 16 << 20:
            out[-1][2].append((offset, length))
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def _parsed(member: bytes, where: str) -> tuple:
    """A record's values, its digest checked."""
    head, _, rest = zlib.decompress(member, 31).partition(END)
    field = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
    body = rest[: int(field[b"Content-Length"])]
    digest = field[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
    response = field[b"WARC-Type"] == b"response"
    if rest[len(body) :] != END or response and base64.b32encode(hashlib.sha1(body).digest()) != digest:
        raise ValueError(f"{where} is damaged")
    number = lambda k: None if (v := field.get(k, b"<urn:page:null>")[10:-1]) == b"null" else int(v)
    exact = field.get(b"WARC-Target-Base64")
    url = base64.b64decode(exact) if exact else field[b"WARC-Target-URI"]
    return (
        number(b"WARC-Record-ID"), url, field[b"WARC-Type"].decode(), number(b"WARC-Refers-To"), digest.decode(),
        int(field[b"WARC-Full-Length"]), body if response else None,
    )


def fetch(selected: DataFrame) -> DataFrame:
    """The records of index rows: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (null for a revisit).

    Index rows are sorted by file and offset; each task reads its own stretches of files in merged ranges, a batch of
    rows at a time. A payload that does not match its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, set[tuple[int, int]]] = {}
            for p, o, n in zip(*[batch[c].to_pylist() for c in ("path", "offset", "length")]):
                by_path.setdefault(p, set()).add((o, n))
            for p, wanted in by_path.items():
                store, at = fs.FileSystem.from_uri(unquote(p))
                out: list[tuple] = []
                with store.open_input_file(at) as held:
                    for a, b, members in _ranges(sorted(wanted), GAP):
                        data = held.read_at(b - a, a)
                        out += [_parsed(data[o - a : o - a + n], f"record at {o} of {p}") for o, n in members]
                        if sum(len(x[-1] or b"") for x in out) > 8 << 20:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    files = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        selected.select("path", "offset", "length")
        .repartition(files, "path")
        .sortWithinPartitions("path", "offset")
        .mapInArrow(run, "page_id bigint, url binary, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary")
    )
    return found.withColumns({c: F.col(c).cast("string") for c in ("url", "payload")})


_KINDS = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
_NAMES = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)
