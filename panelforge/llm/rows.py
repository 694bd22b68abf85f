"""Rows through Python workers, whatever their columns are called."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def filtered(docs: DataFrame, text_col: str, prepare: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows that a worker's judge of texts keeps, as they are. prepare() gives the judge, once a task."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")

    def keep(batches):
        judge = prepare()
        for batch in batches:
            ok = np.asarray(judge(batch.column("text").to_pylist()), bool)
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(ok))], names=["row"])

    out = docs.select(whole, F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(keep, StructType([StructField("row", docs.schema)]))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
