"""Shared pieces of the text operators: table access, lineage cuts and word hashing.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text.  Hashes are
64-bit, computed for whole batches at once: a polynomial over the bytes of a word by
prefix sums, then a bijective finaliser so that word hashes can be combined linearly.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text hashed at once and rows of one Arrow batch; they bound what one Python worker holds.
CHUNK_BYTES, BATCH_ROWS = 1 << 18, 1000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = (np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spare(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as keep them apart from all columns."""
    taken, front = {c.lower() for c in columns}, "__"
    while any(f"{front}{n}".lower() in taken for n in names):
        front += "_"
    return [f"{front}{n}" for n in names]


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without the columns that an operator is about to add, in whatever case they are written."""
    taken = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names, in whatever case, called otherwise, and what gives a result docs' columns and names back."""
    taken, columns = {n.lower() for n in names}, docs.columns
    other = dict(zip([c for c in columns if c.lower() in taken], spare([*columns, *names], *[f"kept{i}" for i, c in enumerate(columns) if c.lower() in taken])))
    renamed = docs.select(*[F.col(f"`{c}`").alias(other.get(c, c)) for c in columns]) if other else docs
    return renamed, lambda result: result.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the cluster names none (a local test session) is a local folder set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
    import tempfile

    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def small_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that its session sends Python workers at most BATCH_ROWS rows at once: rows are whole texts here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


#: Folders that materialize has written and nothing has deleted yet.
_written: list[str] = []


def materialize(df: DataFrame, release: bool = True) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them: cuts the lineage and survives lost executors.

    Unless ``release`` is false, the shuffle files of the step are given back at once: Spark drops
    them when the driver's garbage is collected, which on an idle driver may be long after.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    _written.append(path)
    df.write.parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyspark_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``materialize`` result that nothing reads any more."""
    delete(df.sparkSession, df._tallyspark_path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what was materialized inside: for steps whose result has been written elsewhere by then."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            delete(spark, path)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a job has written this folder to the end."""
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(context._jsc.hadoopConfiguration()).exists(mark)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


class Words:
    """The words of several texts: byte bounds in ``data``, 64-bit hashes, and the bounds of each text's words."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        buffer = np.frombuffer(self.data + b"\n", np.uint8)
        space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        up, down = _power_tables(len(buffer) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[buffer] * up[: len(buffer)], dtype=np.uint64)])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.bounds = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))

    def __len__(self) -> int:
        return len(self.bounds) - 1


def gram_hashes(words: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """Hashes of each n consecutive words; empty if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factor, out = np.uint64(mix(np.full(1, seed, np.uint64))[0] | np.uint64(1)), np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * factor + words[i : len(words) - n + 1 + i]
    return mix(out)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) in runs of about ``limit`` bytes; null counts as empty, a longer text stands alone."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if run and size + len(raw) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run
