"""What the corpus operators share: table reading, the shared scratch folder, bounded batches and broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker works on at once, and of a batch sent to it; a longer text is worked on by itself.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Bytes at most that a table of numbers takes when it is broadcast, at so many a field.
BROADCAST_BYTES, FIELD_BYTES = 16 << 20, 24
FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DoubleType)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to BATCH_BYTES if it is higher. All operators that hand texts to Python
    set this same bound, so none depends on which came last; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


_kept: dict[str, object] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps under a name from task to task. It keeps one thing: another name's is dropped first, so a
    worker that goes from one operator to the next holds the memory of one."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[name] = make()
    return _kept[name]


def give_back() -> None:
    """Return memory that this process no longer uses to the system: Arrow's, and the C library's where it has a call for that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of a batch's rows (texts, or lists of 4-byte numbers) that hold about limit bytes each, so that what a worker makes of
    them stays bounded whatever the batch; a row that alone exceeds it is a range of its own."""
    lo, held = 0, 0
    sizes = pc.multiply(pc.list_value_length(texts), 4) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    for k, n in enumerate(sizes.to_pylist()):
        if k > lo and held + (n or 0) > limit:
            yield lo, k
            lo, held = k, 0
        held += n or 0
    if lo < len(texts):
        yield lo, len(texts)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local
    session (as in tests); on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared_dir.own = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-shared-")
    return shared_dir.own


def scratch(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it again: its lineage is cut, and a lost
    executor costs no recomputation of it."""
    path = f"{shared_dir(df.sparkSession)}/scratch/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, a written table of numbers, marked for broadcast if it takes at most limit bytes; else joins shuffle."""
    if any(not isinstance(f.dataType, FIXED) for f in df.schema):
        raise TypeError("only fields of fixed width have a size known from their count")
    rows = limit // (FIELD_BYTES * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add; they are replaced, also if they differ in case."""
    lowered = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in lowered])


def private(df: DataFrame, **added: Column) -> tuple[DataFrame, dict[str, str]]:
    """df with columns under names that none of its own has, and those names by the given ones."""
    names = {k: f"__{k}_{uuid.uuid4().hex}" for k in added}
    return df.withColumns({names[k]: c for k, c in added.items()}), names
