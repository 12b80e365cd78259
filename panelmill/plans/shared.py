"""Tables that several plans start from: written once a session, for one state of their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelmill.sources import files

_WRITTEN: dict[tuple, tuple[str, object]] = {}


def shared(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` written to the shared folder, or what an earlier call with the same sources wrote.

    The sources count as the same while their files have the same names, sizes and times; a written table that is gone
    is made again. Plans then read narrow columns of it in place of aggregating the sources anew.
    """
    key = (spark.sparkContext.applicationId, name, *(files.stamp(s) for s in sources))
    path, schema = _WRITTEN.get(key, ("", None))
    if not path or not files.exists(path):
        path = files.scratch_dir(spark)
        df = make()
        df.write.parquet(path)
        schema = df.schema
        _WRITTEN[key] = path, schema
    return spark.read.schema(schema).parquet(path)
