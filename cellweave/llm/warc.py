"""WARC archives whose records are zstandard frames under a dictionary kept in the archive itself.

Each archive begins with a skippable frame that holds a dictionary built from the archive's own records; every record is
a frame of its own, so one can be read without the others. A page is a ``response`` record, or, if a page with a larger
id has an equal payload of at least ``REVISIT_BYTES`` bytes, a ``revisit`` that refers to the largest such id.

A task writes its archives under names of its own and reports them; only reported archives are read, so what a lost or repeated
task leaves behind does no harm. Null html is an empty payload. Rows that repeat the largest page_id of a group are
all responses; a null page_id is smaller than any other. Other columns are ignored, a null url becomes ``urn:page:<id>``.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import partitions, stored
from cellweave.session import fresh_path

REVISIT_BYTES = 1000
SKIPPABLE = 0x184D2A5D
ROLL_BYTES = 24 << 20  # raw bytes of an archive
TRAIN_BYTES = 2 << 20  # raw bytes of whole records a dictionary is built from
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, raw_bytes long, file_bytes long"
READ = "page_id long, record_type string, refers_to long, url string, payload binary, payload_digest string, payload_length long"


def with_targets(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, refers_to)``; ``refers_to`` is null for responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("content", digest)
    keepers = stored(rows.where("content is not null").groupBy("content").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "revisited")
    # Eight bytes never equal a digest: rows without one find no keeper and don't meet under one key.
    lone = F.unhex(F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0"))
    return rows.withColumn("content", F.coalesce("content", lone)).join(keepers, "content", "left").select(
        "page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One record; the block is an HTTP response, without its body in a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    urn = lambda k: f"<urn:page:{'none' if k is None else k}>"
    heads = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", date),
             ("WARC-Target-URI", (url or urn(page_id)[1:-1]).replace("\r", "%0D").replace("\n", "%0A")),
             ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        heads += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on whole records at even steps, ``TRAIN_BYTES`` of them; too few records serve as they are."""
    step = max(1, sum(map(len, records)) // TRAIN_BYTES)
    some = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    words = dictionary(records)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    words.precompute_compress(level=LEVEL)
    head = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(head)) + head + b"".join(map(pack.compress, records))


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``(page_id, url, payload, refers_to)`` in ``folder``; returns their stored list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def flush() -> pd.DataFrame:
            data, name = archive(held), f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name) as f:
                f.write(data)
            return pd.DataFrame({"file": [name], "records": [len(held)], "raw_bytes": [size], "file_bytes": [len(data)]})

        for b in batches:
            for r in b.itertuples(index=False):
                ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                held.append(record(ids[0], r.url, bytes(r.payload), ids[1], date))
                size += len(held[-1])
                if size >= ROLL_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return stored(rows.mapInPandas(run, MANIFEST), "archives")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed stream."""
    lines = io.BufferedReader(stream, 1 << 16)
    while lines.readline():
        heads = {}
        while (line := lines.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            heads[k] = v
        block = lines.read(int(heads["Content-Length"]))
        lines.read(4)
        yield heads, block


def unpacked(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive; its dictionary comes from the leading frame."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(source.read(size))
    kind = zstandard.DICT_TYPE_AUTO
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    yield from records_of(reader.stream_reader(source, read_across_frames=True))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives: ids, type, target, and the payload as far as the record holds one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        number = lambda v: None if v in (None, "<urn:page:none>") else int(v[len("<urn:page:"):-1])
        for b in batches:
            for name in b["file"]:
                rows, size = [], 0
                with fs.open_input_stream(name) as f:
                    for h, block in unpacked(f):
                        payload = block[block.index(b"\r\n\r\n") + 4:] if h["WARC-Type"] == "response" else None
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), h["WARC-Target-URI"],
                                     payload, h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])))
                        size += len(block)
                        if size >= 4 << 20:
                            yield frame(rows)
                            rows, size = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in READ.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = max(1, min(archives.count(), 4 * partitions(archives.sparkSession)))
    return archives.select("file").repartition(spread).mapInPandas(run, READ)


def report(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back; length and digest of a response come from its payload as read."""
    folder = fresh_path(pages.sparkSession, "warc")
    read = read_archives(write_archives(with_targets(pages), folder), folder)
    return read.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")
