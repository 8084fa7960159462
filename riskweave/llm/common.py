"""What the corpus operators share: the shared folder, written tables and hashes of words.

Lineage is cut with tables written under the folder named by ``spark.checkpoint.dir``, which
all executors of a cluster see; only a local session without that setting (tests, notebooks)
gets a local folder.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder of written intermediate tables, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="riskweave-")
        spark.conf.set("spark.checkpoint.dir", f"file://{found}")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = f"file://{found}"
    return found.rstrip("/")


class Scratch:
    """Tables of one run, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def put(self, df: DataFrame, name: str, *folders: str) -> DataFrame:
        """Write a table, with a folder for each value of some columns, and read it back: lineage ends here and survives lost executors."""
        at = self.path(name)
        df.write.partitionBy(*folders).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._riskweave_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove written tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            at = jvm.org.apache.hadoop.fs.Path(df._riskweave_path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(df: DataFrame, small: DataFrame, key: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """df joined with a table of one row a key; rows of one key of df are dealt to several tasks."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    many = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return df.withColumn("_salt", salt).join(many, [key, "_salt"], how).drop("_salt")


def whole_text(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9FB21C651E98DF25)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64((seed * 0xD1342543DE82EF95 + 77) % 2**64))


_BYTE = stream(11, 256)
_BASE = U64(0x5851F42D4C957F2D)
_power = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)
#: The white space that parts words: space and the bytes 9 to 13.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        n = max(n, 1 << 16)
        back = U64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE)]))
            _inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, back)]))
    return _power, _inverse


#: White space, digits and ASCII marks: what parts runs of letters (bytes from 128 on count as letters).
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(texts: list[str], lower: bool = False, space: np.ndarray = _SPACE, prefix_bytes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of many texts, in bulk; ``space`` marks the bytes between words.

    Returns (hashes, first, bytes, starts, ends): words first[i]:first[i+1] belong to text i;
    bytes are all texts with one space behind each, starts and ends the words' places there.
    With prefix_bytes, hashes has a row for whole words and one for each length of prefix.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWER[data]
    space = space[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * power[: len(data)])])

        def part(stop: np.ndarray) -> np.ndarray:
            return mix((prefix[stop] - prefix[starts]) * inverse[starts] + (stop - starts).astype(U64) * U64(0xA24BAED4963EE407))

        hashes = part(ends) if not prefix_bytes else np.stack([part(ends), *(part(np.minimum(ends, starts + n)) ^ U64(n) for n in prefix_bytes)])
    stops = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
    first = np.concatenate([[0], np.searchsorted(starts, stops)])
    return hashes, first, data, starts, ends


def blocks(texts, most: int = 1 << 22):
    """Slices of a list of texts, of about ``most`` characters each, that bound memory."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def give_back() -> None:
    """Return freed memory to the system: idle Python workers stay alive beside later stages."""
    import pyarrow as pa

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    pa.default_memory_pool().release_unused()


def map_texts(docs: DataFrame, make, columns: str) -> DataFrame:
    """Columns made from (doc_id, text) rows in bulk, Arrow batch by Arrow batch.

    ``make()`` runs once a task and returns a function of a list of texts, whose result is
    (rows, columns): rows names the text of each output row, or None if they match one to one;
    its close(), if any, is called at the task's end.
    doc_id goes through untouched, nulls and large numbers included.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(columns)
    schema = StructType([docs.schema["doc_id"], *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        try:
            for batch in batches:
                ids, texts = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("text")).to_pylist()
                for cut in blocks(texts):
                    rows, out = work(texts[cut])
                    own = ids.slice(cut.start, cut.stop - cut.start).cast(arrow.field(0).type)
                    own = own if rows is None else own.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(v, f.type) for v, f in zip(out, list(arrow)[1:], strict=True))], schema=arrow)
        finally:
            getattr(work, "close", lambda: None)()
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
