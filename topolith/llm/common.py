"""What the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    """A null text counts as an empty one in every operator here."""
    return F.coalesce(F.col(name), F.lit(""))


#: Rows of 64 bits that the hashes of sought rows are marked in at most.
SIEVE = 1 << 17


def may_meet(rows: DataFrame, sought: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a column ``name``: false where no row of ``sought`` has its keys (null equals null), true where one may.

    So that a join moves only the rows it may find. What is broadcast is a
    bitmap of hashes, of 2 MB at most: of very many sought rows more pass for
    nothing. Keys must be of one type on both sides.
    """
    mark = "_sieve"
    while any(c.startswith(mark) for c in (*rows.columns, *sought.columns, name)):
        mark += "_"
    at, word, bit, bits = (f"{mark}{k}" for k in range(4))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn(at, F.pmod(F.xxhash64(*keys), F.lit(64 * SIEVE)))
        return df.withColumn(word, F.shiftright(at, 6)).withColumn(bit, F.expr(f"shiftleft(1L, cast({at} % 64 as int))"))

    held = placed(sought).groupBy(word).agg(F.bit_or(bit).alias(bits))
    found = F.coalesce(F.col(bits).bitwiseAND(F.col(bit)) != 0, F.lit(False))
    return placed(rows).join(F.broadcast(held), word, "left").withColumn(name, found).drop(at, word, bit, bits)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one holds about ``limit`` bytes of a column at most.

    A single value above the limit comes alone: no value is ever cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.nbytes <= limit:
            yield batch
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def to_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
