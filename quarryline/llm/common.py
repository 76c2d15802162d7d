"""Arrow stages, text access and streamed group tests shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder: cuts lineage and survives lost executors."""
    return materialise(df, label)


def arrow_map(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema):
    """Rows made from each Arrow batch on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)

    return df.mapInArrow(run, schema)


def byte_values(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def longs(values) -> pa.Array:
    """64-bit values as signed Arrow integers, bit for bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def changes(columns: list[np.ndarray]) -> np.ndarray:
    """Whether each row differs from the one before it in any column; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int]]:
    """Each batch with one row of context on either side: (rows, first, end of the batch itself).

    Rows come sorted, so a row's group has another row exactly when a neighbour belongs to
    it; groups of any size pass in constant memory.
    """
    previous = current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        following = pa.Table.from_batches([batch])
        if current is not None:
            yield _between(previous, current, following)
            previous = current.slice(current.num_rows - 1)
        current = following
    if current is not None:
        yield _between(previous, current, None)


def _between(previous, current, following):
    parts = [previous] if previous is not None else []
    parts.append(current)
    if following is not None:
        parts.append(following.slice(0, 1))
    first = 1 if previous is not None else 0
    return pa.concat_tables(parts).combine_chunks(), first, first + current.num_rows


def repeated_rows(
    df: DataFrame, keys: list[str], columns: list[str], group: list[str] | None = None
) -> DataFrame:
    """`columns` of the rows whose key occurs more than once.

    With `group`, the first of `keys`, it is their group that must recur; rows still come
    sorted by all keys.
    """
    schema, named = df.select(*columns).schema, group or keys

    def run(batches):
        for rows, first, end in with_neighbours(batches):
            new = changes([rows[k].to_numpy() for k in named])
            alone = new & np.append(new[1:], True)
            mask = ~alone
            mask[:first] = mask[end:] = False
            kept = rows.select(columns).filter(pa.array(mask))
            if kept.num_rows:
                yield from kept.to_batches()

    return df.repartition(*named).sortWithinPartitions(*keys).mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """A column name that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def text_mark(text_column: str):
    """A 64-bit mark that tells rows of one id apart."""
    return F.xxhash64(text_column)


def keep_rows(docs: DataFrame, stay: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of `docs`, all columns, whose (id, mark) is in `stay`; of repeated rows one."""
    mark, number, missing = (unused(docs.columns, n) for n in ("mark", "number", "missing"))
    keys = [mark, number, missing]

    def keyed(rows: DataFrame, value) -> DataFrame:
        return rows.withColumns({number: F.coalesce(value, F.lit(0)), missing: value.isNull()})

    rows = keyed(docs.withColumn(mark, text_mark(text_column)), F.col(id_column).cast("long"))
    wanted = keyed(stay.select("id", F.col("mark").alias(mark)), F.col("id")).select(*keys).distinct()
    return rows.join(wanted, keys).dropDuplicates(keys).select(*docs.columns)
