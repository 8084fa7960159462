"""Media columns: content-addressed payloads in tar shards, rows that point into them.

A text's UTF-8 bytes, padded with 255 to whole rows of 576 samples, are stored as an 8-bit
grey PNG, losslessly. Each task writes the distinct payloads it sees into tar shards of its own
under the shared folder (members are named by digest; plain ``tar`` reads them) and emits rows
of digest, shard, offset and length: no payload is ever shuffled. Copies that several tasks
stored are settled by digest: the smallest (shard, offset) is the one that all rows point to.
Readers open shards by offset: the metadata columns width, height and bits come from range reads
of the PNG header alone, the rest from one range read of the member. A feature string begins with
what the header says and goes on with figures of the samples.

Shard names hold a random part for each attempt, so a retried or speculative task never writes
over another's shard; only rows of committed attempts are read, and a lost executor costs no
payload that a row points to. Shards of attempts that failed are removed once the manifest is
written: the driver compares names of shards, of which there are as many as tasks and fills.

Defined results: null text is empty text, whose payload is one row of 255; equal texts share
one member and all values; repeated rows are kept; only id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, whole_text

WIDTH = 576
PAD = 255
#: A task starts another shard beyond so many bytes.
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads back, about.
READ_BYTES = 64 << 20
#: A payload that more than one in so many rows share is hot: there are fewer of them than this.
HOT = 50_000
#: Bytes of a PNG up to the end of its header chunk.
HEADER = 33
# Fixed value: the PNG signature.
MAGIC = b"\x89PNG\r\n\x1a\n"


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data + bytes([PAD]) * (-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """Samples as an 8-bit grey image, WIDTH to a row, rows unfiltered."""
    rows = len(data) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, WIDTH)
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("no PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made; checks every chunk."""
    width, height, _ = png_header(media[:HEADER])
    at, parts = 8, []
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file."""
    head = struct.pack("100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x", name.encode(), b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"00000000000\0", b" " * 8, b"0", b"", b"ustar\0", b"00", b"", b"", b"0000000\0", b"0000000\0", b"")
    return head[:148] + b"%06o\0 " % sum(head) + head[156:]


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class Shards:
    """Tar shards that one task writes; a payload seen before is not written again."""

    def __init__(self, root: str, most: int):
        self.files, self.base = _files(root)
        self.most, self.out, self.at, self.name = most, None, 0, ""
        self.known: dict[bytes, tuple[str, int, int]] = {}

    def __call__(self, texts: list[str]) -> tuple:
        return None, list(zip(*((len(t.encode("utf-8", "surrogatepass")), *self.put(t)) for t in texts), strict=True))

    def put(self, text: str) -> tuple[bytes, str, int, int]:
        data = payload(text)
        key = hashlib.sha256(data).digest()
        if key not in self.known:
            media = to_png(data)
            if self.out is None or self.at > self.most:
                self.close()
                self.files.create_dir(self.base, recursive=True)
                self.name, self.at = f"{uuid.uuid4().hex[:16]}.tar", 0
                self.out = self.files.open_output_stream(f"{self.base}/{self.name}")
            self.out.write(tar_header(f"{key.hex()}.png", len(media)) + media + bytes(-len(media) % 512))
            self.known[key] = self.name, self.at + 512, len(media)
            self.at += 512 + len(media) + -len(media) % 512
        return key, *self.known[key]

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def store_media(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length): writes shards when evaluated.

    Write the result as a table before use: each evaluation writes shards of its own.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    return map_texts(docs, lambda: Shards(root, shard_bytes), "n_bytes bigint, digest binary, shard string, offset bigint, length bigint")


def locations(manifest: DataFrame) -> DataFrame:
    """(digest, shard, offset, length, copies): the one place of each payload and how many rows have it."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("copies")).select("digest", "at.*", "copies")


def described_rows(rows: DataFrame, described: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows joined with what is known of their payloads. Hot ones, fewer than ``hot``, go to the rows; the others are joined by digest."""
    total = described.agg(F.sum("copies")).first()[0] or 0
    often = described.filter(F.col("copies") * hot > total)
    rest = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(described.filter(F.col("copies") * hot <= total), "digest")
    return rows.join(F.broadcast(often), "digest").unionByName(rest)


def _spread(places: DataFrame) -> DataFrame:
    """Places dealt to tasks by stretches of shards, a bounded stretch each."""
    spark = places.sparkSession
    total = places.agg(F.sum("length")).first()[0] or 0
    return places.repartitionByRange(max(2 * spark.sparkContext.defaultParallelism, total // READ_BYTES), "shard", "offset")


def _read(places: DataFrame, root: str, columns: str, work, head: int | None = None) -> DataFrame:
    """Places with columns that ``work`` makes of the bytes there; rows stay where they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(columns)
    schema = StructType([*places.schema.fields, *added.fields])

    def run(batches):
        files, base = _files(root)
        arrow, opened, name = to_arrow_schema(schema), None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if shard != name:
                    if opened:
                        opened.close()
                    opened, name = files.open_input_file(f"{base}/{shard}"), shard
                rows.append(work(opened.read_at(min(length, head or length), offset)))
            if rows:
                new = [pa.array(v, arrow.field(f.name).type) for v, f in zip(zip(*rows, strict=True), added.fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), *new], schema=arrow)
        if opened:
            opened.close()

    return places.mapInArrow(run, schema)


def read_metadata(places: DataFrame, root: str) -> DataFrame:
    """Places with width, height and bits, from range reads of the headers alone."""
    return _read(places, root, "width int, height int, bits int", png_header, HEADER)


def _features(media: bytes) -> tuple:
    data = from_png(media)
    samples = np.frombuffer(data, np.uint8)
    counts = np.bincount(samples >> 5, minlength=8)
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum())
    figures = f"mean={1000 * int(samples.sum(dtype=np.int64)) // len(samples)} step={1000 * steps // len(samples)} bins=" + "-".join(str(1000 * int(c) // len(samples)) for c in counts)
    return len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-32:]), hashlib.sha256(media).digest(), figures


def read_features(places: DataFrame, root: str) -> DataFrame:
    """Places with payload and media digests and figures of the samples, computed from the bytes read back."""
    return _read(places, root, "payload_bytes bigint, payload_sha binary, tail_crc32 bigint, media_sha binary, figures string", _features)


def remove_strays(manifest: DataFrame, root: str) -> int:
    """Delete shards that no row of a written manifest names: those of attempts that failed."""
    from pyarrow import fs

    files, base = _files(root)
    known = {r[0] for r in manifest.select("shard").distinct().collect()}  # names of shards, not of payloads
    found = [x for x in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.base_name not in known]
    for x in found:
        files.delete_file(x.path)
    return len(found)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text and describe what was stored, a row for each row of ``docs``.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, digest, shard, offset, length, width, height, bits); shards stay under the shared folder.
    """
    keep = Scratch(docs.sparkSession, "media")
    root = keep.path("shards")
    manifest = keep.put(store_media(docs, root, id_col=id_col, text_col=text_col), "manifest")
    remove_strays(manifest, root)
    places = keep.put(locations(manifest), "places")
    ordered = _spread(places).sortWithinPartitions("shard", "offset")
    about = keep.put(read_features(read_metadata(ordered, root), root), "described")
    keep.drop(places)
    hexed = lambda c: F.lower(F.hex(c))
    size = F.concat_ws("x", *[F.col(c).cast("string") for c in ("width", "height", "bits")])
    return described_rows(manifest.select("doc_id", "n_bytes", "digest"), about).select(
        "doc_id", "n_bytes", "payload_bytes", hexed("payload_sha").alias("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), hexed("media_sha").alias("media_sha256"),
        F.concat_ws(" ", size, "figures").alias("feature"), hexed("digest").alias("digest"), "shard", "offset", "length", "width", "height", "bits",
    )
