"""Row ids: the order of the input as data.

Spark has no row order of its own. The id is made once at ingest and travels as a column; it is left out of
deduplication, empty-row tests and profiles by naming it there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from grainmill.operators.star import number_in_order
from grainmill.session import cut_lineage

ROW_ID = "_row_id"


def number_file_rows(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Number rows read from files by file, position of the split in the file, and place in the split. Runs a job.

    No sort of the rows: only the splits (one small row each) are put in order, and each row adds its place within
    its split. The read is checkpointed first so that the places stay the same when executors are lost.
    """
    placed = cut_lineage(
        df.select(
            *df.columns,
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_mid"),
        )
    )
    splits = placed.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, 0)
    offsets = splits.select("_path", "_block", "_first", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    numbered = placed.join(offsets, ["_path", "_block"])
    return numbered.select((F.col("_before") + F.col("_mid") - F.col("_first")).alias(name), *df.columns)


def number_by(df: DataFrame, order: Sequence[str], name: str = ROW_ID) -> DataFrame:
    """Number rows along columns that order them fully, sorted in ranges over all tasks. Runs a job."""
    return number_in_order(df, order, name)
