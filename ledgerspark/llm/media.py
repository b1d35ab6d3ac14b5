"""ISO media containers as columns: write, walk, and read back by the sample tables.

``encode`` stores bytes as a track of uncompressed 8-bit grey frames (24 x 24, so 576
samples a frame) in one media file per row. ``probe`` walks the nested boxes of any such
file, decodes the sample tables (sizes, chunks, chunk offsets, times, sync samples) and
gives codec, duration and the byte ranges of the keyframes; the payload is skipped, not
decoded. ``payload`` joins the samples that the tables name.

Defined results: a null text is empty; an empty payload is one frame of padding; equal
bytes give equal files; a null or damaged file has null columns in ``probe``. Rows are
worked on one by one, so memory is bounded by the longest text. Extra columns pass
through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import prepare

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
TIMESCALE = 25
KEY_EVERY = 12  # every so many frames one is marked as a sync sample
CHUNK = 8  # frames in a chunk
CODEC = b"raw "
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta"}


def padded(data: bytes) -> bytes:
    frames = max(1, -(-len(data) // FRAME))
    return data + bytes([PAD]) * (frames * FRAME - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def container(payload: bytes) -> bytes:
    """A media file of grey frames over ``payload`` (a multiple of the frame size)."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK)
    runs = [(1, CHUNK)] if frames % CHUNK == 0 else [(1, CHUNK), (chunks, frames % CHUNK)]
    if chunks == 1:
        runs = [(1, frames)]
    keys = range(1, frames + 1, KEY_EVERY)
    entry = box(
        CODEC,
        bytes(6) + struct.pack(">H", 1),
        bytes(16) + struct.pack(">2H2I", SIDE, SIDE, 0x480000, 0x480000),
        bytes(4) + struct.pack(">H", 1) + bytes(32) + struct.pack(">Hh", 40, -1),
    )
    wide = len(payload) >= (1 << 32) - (1 << 24)

    def movie(start: int) -> bytes:
        offsets = [start + k * CHUNK * FRAME for k in range(chunks)]
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">3I", 1, frames, 1)),
            full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", a, n, 1) for a, n in runs)),
            full(b"stsz", struct.pack(">2I", FRAME, frames)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, frames, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, frames), bytes(16), _MATRIX, struct.pack(">2I", SIDE << 16, SIDE << 16), flags=7)
        head = full(b"mvhd", struct.pack(">4I", 0, 0, TIMESCALE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, box(b"trak", track, media))

    kind = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    ahead = len(kind) + len(movie(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return kind + movie(ahead) + box(b"mdat", payload)


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} runs past its parent")
        yield kind, body, stop
        start = stop


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator:
    """(path, body, end) of every box below, parents first; bodies are not read."""
    for kind, body, stop in boxes(data, start, end):
        yield (*path, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))


def tracks(data: memoryview) -> list[dict]:
    """Each track's codec, times and samples (start, bytes, whether it is a sync sample)."""
    found: list[dict] = []
    for path, body, stop in walk(data, 0, len(data)):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif kind == b"mdhd":
            wide = data[body] == 1
            found[-1]["times"] = struct.unpack_from(">IQ" if wide else ">2I", data, body + (20 if wide else 12))
        elif path[-2:-1] == (b"stbl",):
            found[-1][kind] = (body + 4, stop)
    return [_samples(data, t) for t in found]


def _table(data: memoryview, at: int, form: str) -> list[tuple]:
    """Rows of a table that starts with its row count."""
    (n,) = struct.unpack_from(">I", data, at)
    size = struct.calcsize(f">{form}")
    return list(struct.iter_unpack(f">{form}", data[at + 4 : at + 4 + n * size]))


def _samples(data: memoryview, t: dict) -> dict:
    at = t[b"stsz"][0]
    fixed, n = struct.unpack_from(">2I", data, at)
    sizes = [fixed] * n if fixed else [x for (x,) in _table(data, at + 4, "I")]
    offsets = _table(data, t[b"co64"][0], "Q") if b"co64" in t else _table(data, t[b"stco"][0], "I")
    runs = _table(data, t[b"stsc"][0], "3I")
    sync = {x for (x,) in _table(data, t[b"stss"][0], "I")} if b"stss" in t else None
    samples, k = [], 0
    for run, (first, per, _) in enumerate(runs):
        until = runs[run + 1][0] if run + 1 < len(runs) else len(offsets) + 1
        for chunk in range(first, until):
            place = offsets[chunk - 1][0]
            for _ in range(per):
                if k == len(sizes):
                    break
                samples.append((place, sizes[k], sync is None or k + 1 in sync))
                place += sizes[k]
                k += 1
    length = sum(count * step for count, step in _table(data, t[b"stts"][0], "2I"))
    codec = bytes(data[t[b"stsd"][0] + 8 : t[b"stsd"][0] + 12]).decode("latin-1")
    return {"codec": codec, "timescale": t["times"][0], "duration": length, "samples": samples}


def payload(media: bytes) -> bytes:
    """The samples of the first track, as the tables place them."""
    return b"".join(media[a : a + n] for a, n, _ in tracks(memoryview(media))[0]["samples"])


def encode(docs: DataFrame, name: str = "media") -> DataFrame:
    """``docs`` with its texts stored as media files in column ``name`` (an earlier one goes)."""
    prepare(docs.sparkSession)
    docs = docs.drop(name)
    row = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [container(padded(t.as_py().encode())) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(files, pa.binary())], ["row", "media"])

    kind = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {kind}, media binary").select("row.*", F.col("media").alias(name))


PROBED = (
    "doc_id {id}, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string,"
    " tail_crc32 long, codec string, timescale long, duration long, n_samples long,"
    " keyframes array<struct<start: long, bytes: long>>"
)


def probe(files: DataFrame) -> DataFrame:
    """Media columns of ``files`` (doc_id, n_bytes, media): see ``PROBED``.

    Payload digests are of the bytes that the sample tables name.
    """
    prepare(files.sparkSession)
    schema = PROBED.format(id=files.schema["doc_id"].dataType.simpleString())

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 10
        head = (len(data), hashlib.sha256(data).hexdigest())
        try:
            t = tracks(memoryview(data))[0]
        except (ValueError, IndexError, KeyError, struct.error):
            return (*head, *(None,) * 8)
        whole, tail, size = hashlib.sha256(), b"", 0
        for start, n, _ in t["samples"]:
            sample = data[start : start + n]
            whole.update(sample)
            tail = (tail + sample)[-32:]
            size += n
        keys = [{"start": a, "bytes": n} for a, n, k in t["samples"] if k]
        return (*head, size, whole.hexdigest(), zlib.crc32(tail), t["codec"], t["timescale"], t["duration"], len(t["samples"]), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("start", pa.int64()), ("bytes", pa.int64())]))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), ranges]
        for batch in batches:
            rows = [one(m.as_py()) for m in batch.column(2)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], _NAMES)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


_NAMES = ["doc_id", "n_bytes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "codec", "timescale", "duration", "n_samples", "keyframes"]


def digest(docs: DataFrame) -> DataFrame:
    """Per row: sizes and digests of payload and file, and the feature string."""
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    files = encode(docs.select("doc_id", "text", size))
    ranges = F.transform("keyframes", lambda k: F.concat_ws("+", k["start"], k["bytes"]))
    feature = F.concat_ws(
        ";",
        F.trim("codec"),
        F.concat(F.col("duration"), F.lit("/"), F.col("timescale")),
        F.col("n_samples").cast("string"),
        F.size("keyframes").cast("string"),
        F.md5(F.concat_ws(",", ranges)),
    )
    return probe(files).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        feature.alias("feature"), "codec", "duration", F.size("keyframes").alias("n_keyframes"), "keyframes",
    )
