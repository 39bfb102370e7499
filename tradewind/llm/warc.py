"""Web archives: WARC records in files that bring their own Zstandard dictionary.

A file begins with a skippable frame that holds a dictionary, learnt from all of the records
that follow; each record is a frame of its own, so that a reader can begin at any of them.
Pages with equal payloads are stored once: the greatest page is a response, the others are
revisits that name it. Files hold a bounded number of payload bytes, so neither the writer
nor the reader ever holds more than one of them and the records of one Arrow batch.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import drop_path, stage
from .simhash import with_place

#: Payload bytes after which a file is closed; a record stays whole.
FILE_BYTES = 16 << 20
DICTIONARY_BYTES = 110 << 10
LEVEL = 3
CAPTURED = "1970-01-01T00:00:00Z"
#: The skippable frame of a dictionary, the first bytes of a frame, and the profile of a revisit.
DICTIONARY_FRAME, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_PIECE = 1 << 16


def _key(payload: Column) -> Column:
    """What equal payloads share and no others: 256 bits, as pages come from strangers."""
    return F.sha2(F.coalesce(payload, F.lit("")).cast("binary"), 256)


def revisits(placed: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(file, row, to_id, to_file, to_row): rows whose payload, of `min_bytes` or more, another row has too, with that row.

    That is the row of the greatest id, null ids being least; of equal ids the last in place.
    Counts are combined before their shuffle. A payload that more than a thousandth of all
    rows share is looked up by a broadcast of such, of which there are fewer than a thousand;
    the others meet by a join in which none has more rows than that.
    """
    facts = placed.select("file", "row", F.col(id_col).alias("id"), _key(F.col(payload_col)).alias("k"), F.coalesce(F.octet_length(payload_col), F.lit(0)).alias("n"))
    facts = stage(facts.where(F.col("n") >= min_bytes).drop("n"), "payloads")
    top = F.max(F.struct("id", "file", "row"))
    groups = stage(facts.groupBy("k").agg(F.count("*").alias("n"), top.alias("to")).where("n > 1"), "payload-groups")
    total = facts.count()
    large = groups.where(F.col("n") * 1000 > total).select("k", "to")
    small = groups.where(F.col("n") * 1000 <= total).select("k", "to")
    found = facts.join(F.broadcast(large), "k", "left")
    met = found.where("to is not null").unionByName(found.where("to is null").drop("to").join(small, "k"))
    other = (F.col("file") != F.col("to.file")) | (F.col("row") != F.col("to.row"))
    return met.where(other).select("file", "row", F.col("to.id").alias("to_id"), F.col("to.file").alias("to_file"), F.col("to.row").alias("to_row"))


def _name(file: int, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'tradewind:{file}:{row}')}>"


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page: dict, captured: str = CAPTURED) -> bytes:
    """The record of a page (id, file, row, url, payload bytes, to_id, to_file, to_row): a revisit if to_file is not null.

    Characters that would break a header line are percent-encoded in the url; a null url is 'about:blank'.
    """
    payload = page["payload"]
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", page["url"] if page["url"] is not None else "about:blank")
    again = page["to_file"] is not None
    fields = [("WARC-Record-ID", _name(page["file"], page["row"])), ("WARC-Date", captured), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Page-ID", page["id"])]
    if again:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _name(page["to_file"], page["to_row"])), ("Page-Refers-To", page["to_id"]), ("Page-Payload-Length", len(payload))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("revisit" if again else "response", fields, http if again else http + payload)


def pack(records: list[bytes], name: str, captured: str = CAPTURED) -> bytes:
    """A whole file of `records` after one that names the file; without a dictionary if there is too little to learn from."""
    info = _record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", captured), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    held = sum(map(len, records))
    learnt = None
    if len(records) >= 8:
        try:
            learnt = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, held // 16)), records, k=1024, d=8, f=20, accel=4, split_point=1.0)
        except zstandard.ZstdError:  # samples too short or too much alike for the trainer
            learnt = None
    if learnt is None:
        packer, out = zstandard.ZstdCompressor(level=LEVEL), []
    else:
        learnt.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=learnt)
        body = zstandard.ZstdCompressor(level=19).compress(learnt.as_bytes())
        out = [struct.pack("<II", DICTIONARY_FRAME, len(body)), body]
    out += [packer.compress(r) for r in (info, *records)]
    return b"".join(out)


def unpack(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each frame of a file."""
    view, at, learnt = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        body = bytes(view[8:at])
        learnt = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body) if body.startswith(FRAME_MAGIC) else body)
    reader = zstandard.ZstdDecompressor(dict_data=learnt) if learnt else zstandard.ZstdDecompressor()
    while at < len(data):
        frame, begin, parts = reader.decompressobj(), at, []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last frame of the archive is cut off")
            parts.append(frame.decompress(view[at : at + _PIECE]))
            at = min(len(data), at + _PIECE)
        at -= len(frame.unused_data)
        yield begin, b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or len(rest) != size + 4:
        raise ValueError("no whole WARC record")
    return fields, rest[:size]


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES, captured: str = CAPTURED) -> DataFrame:
    """Write a record for each row of `pages` below `path`; (archive, n_records, payload_bytes) of the files.

    The payload is the text in UTF-8, a null text an empty one. Rows may repeat, ids may be null
    (a record without a page id) and other columns are not looked at; an empty table writes no
    file. Names carry the task's attempt, and files of attempts that did not end are removed,
    so that a lost executor leaves neither gaps nor repeats.
    """
    spark = pages.sparkSession
    placed = with_place(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload")))
    again = revisits(placed, "id", "payload", min_bytes)
    rows = placed.join(again, ["file", "row"], "left").withColumn("payload", F.coalesce("payload", F.lit("")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        made, held, records = 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal made, held, records
            name = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}-{made:04d}.warc.zst"
            files.write_whole(f"{path}/{name}", pack(records, name, captured), "draft")
            told = pa.RecordBatch.from_pydict({"archive": [name], "n_records": [len(records)], "payload_bytes": [held]})
            made, held, records = made + 1, 0, []
            return told

        for batch in batches:
            for k in range(batch.num_rows):
                page = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                records.append(page_record(page, captured))
                held += len(page["payload"])
                if held >= file_bytes:
                    yield close()
        if records:
            yield close()

    index = stage(rows.mapInArrow(run, "archive string, n_records long, payload_bytes long"), "archives")
    for orphan in _listed(spark, path, index).join(index, "archive", "left_anti").toLocalIterator():
        drop_path(spark, f"{path}/{orphan.archive}")
    return index


def _listed(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(archive): the files below `path`; none where nothing was written."""
    if index.isEmpty():
        return index.select("archive")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"))


_READ = "archive string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(archive, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload) of each page record below `path`.

    Whole files are read; a response's payload is checked against the digest in its header, and
    a file that is cut off or does not fit is an error. `payload` is null for revisits, and for
    all without `payloads`. Digests are bare base32 of SHA-1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        for batch in batches:
            for k in range(batch.num_rows):
                archive = batch.column("path")[k].as_py().rsplit("/", 1)[-1]
                rows, held = [], 0
                for offset, record in unpack(batch.column("content")[k].as_py()):
                    fields, block = parse(record)
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    size = int(fields["Page-Payload-Length"]) if payload is None else len(payload)
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{archive}: the record at {offset} does not have its digest")
                    number = lambda name: int(fields[name]) if name in fields else None  # noqa: B023, E731
                    rows.append((archive, offset, kind, number("Page-ID"), fields["WARC-Target-URI"], size, digest, number("Page-Refers-To"), payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if held >= FILE_BYTES or len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    return found.mapInArrow(run, _READ)
