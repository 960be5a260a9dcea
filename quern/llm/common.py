"""What the corpus operators share: scratch tables on shared storage and Arrow batch helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from quern.sources import scratch

#: The ASCII white space of the contracts, as a Java / RE2 character class body.
WS = r"\x20\x09-\x0D"
#: Python kernels work through a batch in slices of about so many text bytes.
SLICE_BYTES = 4 << 20


#: Tables that stored() wrote in the innermost temporaries().
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that stored() writes inside, but for the last of them, the result, which counts as written by what is around."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
        result = made.pop() if made else None
    finally:
        _made.reset(token)
        for path in made:
            scratch.drop(spark, path)
    around = _made.get()
    if result and around is not None:
        around.append(result)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again: the lineage ends there, and lost
    executors cost no recomputation. Unlike checkpoint() the rows are computed once. The table stays until the
    folder is cleared, since later plans may read it at any time, or until the end of temporaries()."""
    path = f"{scratch.folder(df.sparkSession)}-{label}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), with this package sent to the executors first, once for each application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        package = Path(__file__).parents[1]
        folder = Path(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(folder / "quern_package.zip", "w") as z:
            for f in package.rglob("*.py"):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(folder / "quern_package.zip"))
    odd = {c: f"__quern_column_{i}" for i, c in enumerate(df.columns) if set(".`") & set(c)} if isinstance(schema, StructType) else {}
    if not odd:
        return df.mapInArrow(run, schema)
    # mapInArrow cannot name columns with dots
    plain = StructType([StructField(odd.get(f.name, f.name), f.dataType, f.nullable) for f in schema])
    return df.toDF(*(odd.get(c, c) for c in df.columns)).mapInArrow(run, plain).toDF(*schema.names)


def quoted(names: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they have."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df in bytes (the file sizes, for a scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def plus(schema: StructType, name: str, kind: str) -> StructType:
    """A new schema with one more column."""
    return StructType([*schema.fields, StructField(name, DataType.fromDDL(kind))])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about `most` bytes in `column`; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(byte_lengths(batch.column(batch.schema.get_field_index(column))))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each row, null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]
