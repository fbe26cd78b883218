"""Helpers shared by the operators of this package.

A text column is read as UTF-8 bytes in Arrow batches; a null text counts as
empty.  Words are the runs of ``[^\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` returns.
"""

from __future__ import annotations

import ctypes
import gc
import os
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialized, session_dir

#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage,
    so that a lost executor costs one read and no recomputation."""
    return materialized(df, name)


def dropped(df: DataFrame) -> None:
    """Deletes what ``saved`` has written of ``df``, which nothing may read any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    own = session_dir(df.sparkSession).rsplit("/", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        if place.getParent().getName() == own:
            place.getFileSystem(conf).delete(place, True)


def swept(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of jobs that are done.  It does so once the
    driver's garbage collection finds their plans gone; by itself that may come
    after all steps, whose files then lie on the disks together.  What one
    collection frees lets a second one find the shuffles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.4)
    spark.sparkContext._jvm.System.gc()


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text (null id: empty), modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes (null: empty)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: What an operator's tasks keep in this worker process.
_HELD: dict[tuple, object] = {}
#: The C library's call to give freed memory back to the machine, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def held(key: tuple, make: Callable[[], object]) -> object:
    """The worker's object of this key, kept for later tasks.  Workers outlive a
    stage, so what another key has kept is dropped first."""
    if key not in _HELD:
        released()
        _HELD[key] = make()
    return _HELD[key]


def released() -> None:
    """Drops what an earlier operator has kept in this worker, and gives the
    memory that it has freed back: the executor's JVM and workers share a limit."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def append(df: DataFrame, inputs: list[str], fn: Callable[..., list[pa.Array]], fields: list[T.StructField], holds: bool = False) -> DataFrame:
    """``df`` with the columns that ``fn`` computes from the ``inputs`` of each
    Arrow batch, in one pass over the data.  ``holds``: it uses ``held``."""
    schema = T.StructType([*df.schema.fields, *fields])
    names = schema.names
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            released()
        for batch in batches:
            new = fn(*[batch.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``limit`` summed sizes each; a row
    over the limit is a part of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def parts(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut to about ``limit`` bytes of text each."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            yield from slices(batch, sizes.astype(np.int64), limit)


def coded(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    """The words' numbers; new words extend ``vocabulary``."""
    add = vocabulary.setdefault
    return np.fromiter([add(w, len(vocabulary)) for w in words], np.int64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    """XXH64 of each word, the same on every worker."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter([h(w) for w in words], np.uint64)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob (see ``unpacked``)."""
    import zstandard

    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of ``packed``, all of one length, by their dtypes."""
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, zstandard.frame_content_size(blob)))
    n, at, out = len(body) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(body, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def buckets(spark: SparkSession, scale: int = 1) -> int:
    """Number of hash buckets, following the session's shuffle partitions
    (which the cluster sizes to the data)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * scale)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return public_tokenizers.path(name)
