"""What several operators share: durable intermediate tables, bounded samples, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skyledger.scratch import Scratch

#: The 26 letters that the contracts lower-case, and no others.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Tables of single ids are broadcast up to so many rows, about 8 MB; beyond, they are joined.
MOST_IDS = 500_000


def near(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if its count is within the bound."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, class_col: str, key_cols: list[str], per_class: int, *, most_rows: int = 100_000) -> DataFrame:
    """About per_class different rows of each class that is not null, and never more; classes of any number.

    Rows are told apart by a hash of key_cols, so that rows without id, or many rows of one id, are
    drawn like any others; of equal rows one is drawn. The draw is the same in any run. The result has
    most_rows rows at most: with many classes, each gives an equal share of that, one row at least;
    of more than most_rows classes those of the smallest hashes are kept.
    """
    names = spare(df.columns, "h", "n", "place", "class")
    h, n, place, of = names
    rows = df.where(F.col(class_col).isNotNull()).withColumn(h, F.xxhash64(*key_cols, F.lit(17)))
    counts = rows.groupBy(F.col(class_col).alias(of)).agg(F.approx_count_distinct(h, 0.02).alias(n))
    counts = Scratch(df.sparkSession, "sample").save(counts, "counts")
    classes = counts.count()
    per = max(1, min(per_class, most_rows // max(classes, 1)))
    if classes > most_rows:
        counts = counts.orderBy(F.xxhash64(of)).limit(most_rows)
    # Twice as many as wanted pass the hash; the window's limit by task and group then cuts exactly.
    scale = 1 << 30
    drawn = rows.join(near(counts), rows[class_col] == counts[of]).where(F.pmod(F.col(h), F.lit(scale)) < F.lit(2.0 * per * scale) / F.col(n))
    drawn = drawn.withColumn(place, F.row_number().over(W.partitionBy(of, h).orderBy(h))).where(F.col(place) == 1)
    drawn = drawn.withColumn(place, F.row_number().over(W.partitionBy(of).orderBy(F.pmod(F.col(h), F.lit(scale)), h))).where(F.col(place) <= per)
    return drawn.select(*df.columns)


def spare(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are not among those taken, in any case."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name in low:
            name += "_"
        low.add(name)
        out.append(name)
    return out


def whole_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """All of docs in one column `row`, beside the columns given; so no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


ROWS = 1000


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function made once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):  # small pieces, so that results stay small too
                yield f(batch.slice(start, ROWS))
            release()
        del f
        release()

    return df.mapInArrow(run, schema)


def with_columns(rows: DataFrame, added: str, *, without: str) -> StructType:
    """The schema of rows, less one column, and the added ones (as DDL)."""
    kept = StructType([f for f in rows.schema if f.name != without])
    return StructType(kept.fields + StructType.fromDDL(added).fields)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
