"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames of whole records, closed by a seek
table in a skippable frame.  The index maps each record to its bundle, frame and offset
inside the frame, so that one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import fresh_dir, mapped, runs, slices, staged, store, tune, write_arrays

FRAME_BYTES = 1 << 20  #: records of a frame, before compression; a larger record is a frame of its own
BUNDLE_BYTES = 128 << 20  #: frames of a bundle, before compression

#: Fixed values of the seekable format's skippable frame.
_SKIPPABLE_MAGIC = 0x184D2A5E
_SEEKABLE_MAGIC = 0x8F92EAB1

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit names the response of the same payload and leaves the
    payload out, but says how long it is."""
    kind = "response" if refers_to is None else "revisit"
    block = _HTTP + payload if refers_to is None else _HTTP
    fields = [
        f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_header(page_id)}>", f"WARC-Target-URI: {_header(url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{_header(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join(["WARC/1.1", *fields, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at offset {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        yield at, fields, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _urn(value: str) -> str:
    return _unheader(value.removeprefix("<urn:page:").removesuffix(">"))


class BundleWriter:
    """Writes one bundle under a name of its own: a task that is run again writes another
    file, and only the index rows of the attempt that counts name theirs."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = store(self.uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)  # not by the name
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer: list[bytes] = []
        self.size = self.total = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.buffer and self.size + len(raw) > FRAME_BYTES:
            self.flush()
        place = (len(self.frames), self.size)
        self.buffer.append(raw)
        self.size += len(raw)
        self.total += len(raw)
        return place

    def flush(self) -> None:
        if self.buffer:
            packed = self.zstd.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(file) -> list[tuple[int, int]]:
    """Where each frame starts and how long it is, read from the end of a bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    sizes = struct.unpack(f"<{2 * count}I", file.read(8 * count))[::2]
    starts, at = [], 0
    for n in sizes:
        starts.append((at, n))
        at += n
    return starts


def read_frame(file, place: tuple[int, int]) -> bytes:
    file.seek(place[0])
    return zstandard.ZstdDecompressor().decompress(file.read(place[1]))


def read_record(uri: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record, by decompressing only its frame."""
    files, path = store(uri)
    with files.open_input_file(path) as file:
        raw = read_frame(file, seek_table(file)[frame])
    _, fields, block = next(parse_records(raw[offset:]))
    return fields, block


@dataclass
class Responses:
    """Ids of the responses of payloads that repeat: sorted digests and the ids' texts, in files
    of the shared folder, by the digests' top bits."""

    bits: int
    files: dict[str, dict[int, tuple[str, str, int]]] = field(default_factory=dict)

    def array(self, name: str, bucket: int) -> np.ndarray:
        return mapped(*self.files[name][bucket])

    def of(self, sha1: list[str]) -> list[str | None]:
        """Id of the response of each payload, None for one that does not repeat."""
        digests, out = _digests(sha1), [None] * len(sha1)
        top = digests.view(np.uint8).reshape(-1, 20)[:, :3].astype(np.int64) @ [1 << 16, 1 << 8, 1] >> (24 - self.bits)
        order = np.argsort(top)
        for b, low, high in runs(top[order]):
            if b not in self.files.get("digests", {}):
                continue
            rows, known = order[low:high], self.array("digests", b)
            at = np.minimum(np.searchsorted(known, digests[rows]), len(known) - 1)
            found = known[at] == digests[rows]
            ends, ids = self.array("ends", b), self.array("ids", b)
            for row, k in zip(rows[found], at[found], strict=True):
                out[row] = ids[ends[k] : ends[k + 1]].tobytes().decode()
        return out


def _digests(sha1: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(sha1)), "S20")


def _responses(rows: DataFrame, min_bytes: int, folder: str) -> Responses:
    """The responses of payloads of ``min_bytes`` or more that repeat; only digests and ids are shuffled."""
    spark = rows.sparkSession
    bits = min(24, max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    groups = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("id").cast("string").alias("last"), F.count("*").alias("n"))
    groups = groups.filter("n > 1 AND last IS NOT NULL").select("sha1", "last", F.shiftright(F.conv(F.substring("sha1", 1, 6), 16, 10).cast("int"), 24 - bits).alias("bucket"))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        digests, ids = _digests(group["sha1"].tolist()), [i.encode() for i in group["last"]]
        order = np.argsort(digests)
        ids = [ids[k] for k in order]
        arrays = {"digests": digests[order], "ends": np.cumsum([0, *map(len, ids)]), "ids": np.frombuffer(b"".join(ids), np.uint8)}
        out = pd.DataFrame(write_arrays(folder, arrays), columns=["name", "uri", "dtype", "n"])
        return out.assign(bucket=int(group["bucket"].iloc[0]))[["name", "bucket", "uri", "dtype", "n"]]

    found = Responses(bits)
    for r in groups.groupBy("bucket").applyInPandas(write, "name string, bucket int, uri string, dtype string, n bigint").collect():
        found.files.setdefault(r["name"], {})[r["bucket"]] = (r["uri"], r["dtype"], r["n"])
    return found


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record for each row and returns the index ``id_col, bundle, frame, offset``.

    Of records with equal payloads (the html in UTF-8) of ``min_bytes`` bytes or more, the
    one with the largest id is the response and the others revisit it; shorter ones are all
    responses.  A null html is an empty payload, a null url an empty one; a row with a null
    id is a revisit where its payload has a response with an id.  Rows that repeat the
    response's id are responses too.  Other columns are not read; an empty table writes no
    file.

    Pages are written by the tasks that read them: they are not shuffled, so a payload that
    many pages share stays spread over these.  Tasks look the responses of repeating payloads
    up in mapped files.
    """
    tune(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    responses = _responses(rows, min_bytes, fresh_dir(pages.sparkSession, "warc-responses"))
    rows = rows.select("id", F.col("id").cast("string").alias("own"), "url", "sha1", "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for part in slices(batch, "html"):
                ids, found = part.column(0), []
                own, url, sha1, html = (c.to_pylist() for c in part.columns[1:])
                for o, u, s, h, last in zip(own, url, sha1, html, responses.of(sha1), strict=True):
                    if bundle is None or bundle.total > BUNDLE_BYTES:
                        if bundle:
                            bundle.close()
                        bundle = BundleWriter(folder)
                    digest = base64.b32encode(bytes.fromhex(s)).decode()
                    found.append((bundle.uri, *bundle.add(record(o or "", u, h.encode(), digest, None if o == last else last))))
                uris, frames, offsets = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([ids, pa.array(uris, pa.string()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], names=[id_col, "bundle", "frame", "offset"])
        if bundle:
            bundle.close()

    return rows.mapInArrow(write, f"`{id_col}` {kind}, bundle string, frame int, offset bigint")


def read_bundles(bundles: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Reads all records of the archives in column ``bundle``: ``page_id, url,
    payload_bytes, payload_digest, record_type, refers_to``.

    Length and digest of a response are those of the payload that was read, and have to
    agree with its header; a revisit's are its header's.  A record without an id has null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = store(uri)
                with files.open_input_file(path) as file:
                    for place in seek_table(file):
                        rows = [_row(fields, block) for _, fields, block in parse_records(read_frame(file, place))]
                        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])
    text = bundles.select("bundle").mapInArrow(read, "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")
    return text.withColumn("page_id", F.nullif("page_id", F.lit("")).cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _row(fields: dict[str, str], block: bytes) -> dict:
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest or len(payload) != size:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its header")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": _urn(fields["WARC-Record-ID"]), "url": _unheader(fields["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": _urn(refers) if refers else None}


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the archives into ``folder`` (one of its own in the cluster's shared folder
    by default) and returns the index and the records as they are read back."""
    spark = pages.sparkSession
    index = staged(write_bundles(pages, folder or fresh_dir(spark, "warc"), id_col, url_col, html_col, min_bytes), "warc-index")
    # A bundle is one row, whatever the length of its name: dealt evenly, not by bytes.
    bundles = index.select("bundle").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return index, read_bundles(bundles, pages.schema[id_col].dataType.simpleString())
