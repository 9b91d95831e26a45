"""Tables written once, in buckets of their join keys, so that joins and groups by these keys need no shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .scratch import shared_dir


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """df as a table of the session's catalog in the shared folder, a file for each bucket of keys.

    Tables with as many buckets of the same keys join without an exchange, and so do groups and windows by keys that
    include these. A key's rows are one task's: meant for tables with few rows a key, such as a character's items.
    Rows of null keys are one bucket's. As many buckets as shuffle partitions unless told otherwise.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", f"{shared_dir(spark).rstrip('/')}/{table}").saveAsTable(table)
    return spark.table(table)
