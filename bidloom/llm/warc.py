"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table, an index of record ids."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, saved, scratch

#: Uncompressed bytes after which a frame closes, and bytes of a bundle after which it closes.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
LEAST_REVISIT = 1000
#: Frames next to each other that one task reads, and plain bytes of records for which a reading task is planned.
RUN_FRAMES, READ_BYTES = 32, 1 << 24
LEVEL = 3
#: Fixed by the seekable format: skippable frame, its footer.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, url: str | None = None, digest: str = "") -> str:
    """From the page's id, or without one from its url and payload."""
    name = f"page:{page_id}" if page_id is not None else f"page of {digest} at {url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the headers of its payload, and no payload."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, url, digest)}", f"WARC-Date: {_DATE}"]
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head += [f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, end) of the record at an offset of a frame."""
    split = data.index(b"\r\n\r\n", at)
    lines = data[at:split].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start, n = split + 4, int(headers["Content-Length"])
    block = data[start : start + n]
    return headers, block[block.index(b"\r\n\r\n") + 4 :], start + n + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists compressed and plain sizes of all frames before it."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    return struct.pack("<II", _SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, _SEEKABLE)


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(offset, compressed, plain) of each frame, from the end of an open file."""
    size = f.seek(0, 2)
    f.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEKABLE or flags:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * count)
    raw, at, out = f.read(8 * count), 0, []
    for c, d in struct.iter_unpack("<II", raw):
        out.append((at, c, d))
        at += c
    return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to; of equal payloads of at least LEAST_REVISIT bytes,
    that with the largest page_id is the response; rows without an id revisit it too, if there is one."""
    html = F.coalesce("html", F.lit(""))
    df = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("payload_digest"))
    big = df.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    big = saved(big.select(F.col("payload_digest").alias("d"), "first"), "repeated")
    df = df.join(hinted(big), (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= LEAST_REVISIT), "left")
    return df.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("d", "first")


def written(pages: DataFrame, folder: str) -> DataFrame:
    """Writes bundles under folder (a URI that all executors reach) and returns their index, saved.

    Index: page_id, record_id, bundle, frame, frame_offset (in the bundle), offset (in the plain frame), length. A task
    streams its rows: one open frame and one bundle buffer of bounded size at a time. A bundle's name holds the attempt
    that wrote it and the index names bundles, so a task that runs twice, in whatever order of rows, never mixes its
    files with another attempt's; what a failed attempt leaves is in no index. Rows with a null page_id have a record
    without an id of a page; repeated rows have one each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        ctx = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        number, body, frames, frame, index, spot = 0, [], [], [], [], 0

        def close_frame() -> None:
            nonlocal frame, spot
            if frame:
                plain = b"".join(frame)
                packed = packer.compress(plain)
                frames.append((len(packed), len(plain)))
                body.append(packed)
                frame, spot = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal number, body, frames, index
            close_frame()
            name = f"part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(b"".join([*body, seek_table(frames)]))
            number, rows = number + 1, index
            starts = [0]
            for c, _ in frames:
                starts.append(starts[-1] + c)
            body, frames, index = [], [], []
            return pa.RecordBatch.from_pydict(
                {
                    "page_id": pa.array([r[0] for r in rows], pa.int64()), "record_id": [r[4] for r in rows], "bundle": [f"{folder}/{name}"] * len(rows),
                    "frame": pa.array([r[1] for r in rows], pa.int32()), "frame_offset": pa.array([starts[r[1]] for r in rows], pa.int64()),
                    "offset": pa.array([r[2] for r in rows], pa.int64()), "length": pa.array([r[3] for r in rows], pa.int64()),
                }
            )

        for batch in batches:
            for page, url, html, size, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = record(page, url, b"" if refers is not None else html.encode("utf-8", "surrogatepass"), digest, size, refers)
                index.append((page, len(frames), spot, len(one), record_id(page, url, digest)))
                frame.append(one)
                spot += len(one)
                if spot >= FRAME_BYTES:
                    close_frame()
                    if sum(c for c, _ in frames) >= BUNDLE_BYTES:
                        yield close_bundle()
        if index:
            yield close_bundle()

    cols = ["page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to"]
    rows = planned(pages).select(*cols)
    return saved(rows.mapInArrow(run, "page_id long, record_id string, bundle string, frame int, frame_offset long, offset long, length long"), "index")


def read(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of every record that index points to.

    Frames are read by range, each on its own. Runs of neighbouring frames are dealt over as many tasks as the records'
    bytes ask for; a task opens a bundle and reads its seek table once for a run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        now, f, seek = None, None, []
        for batch in batches:
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != now:
                    if f:
                        f.close()
                    store, path = _open(bundle)
                    now, f = bundle, store.open_input_file(path)
                    seek = read_seek_table(f)
                at, packed, plain = seek[frame]
                f.seek(at)
                data = unpacker.decompress(f.read(packed), max_output_size=plain)
                out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
                for spot in offsets:
                    h, payload, _ = parse(data, spot)
                    full = h["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if full else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if full and f"sha1:{digest}" != h["WARC-Payload-Digest"]:
                        raise ValueError(f"{bundle}: the payload of {h['WARC-Record-ID']} is damaged")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page")
                    for c, x in zip(out, (int(page) if page else None, len(payload) if full else int(h["X-Payload-Length"]), digest, h["WARC-Type"], int(refers) if refers else None, payload), strict=True):
                        out[c].append(x)
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
                yield pa.RecordBatch.from_pydict({c: pa.array(x, kinds.get(c, pa.string())) for c, x in out.items()})
        if f:
            f.close()

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # A frame holds about FRAME_BYTES and one record more, so its offsets are a short list.
    units = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    units = units.repartition(max(1, -(-size // READ_BYTES)), "bundle", F.expr(f"frame div {RUN_FRAMES}")).sortWithinPartitions("bundle", "frame")
    return units.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes all pages below the shared folder and reads the archives back."""
    return read(written(pages, scratch(pages.sparkSession, "warc")))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""
