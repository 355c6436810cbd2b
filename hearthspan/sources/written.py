"""Derived inputs that many queries read, written once as partitioned and bucketed tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspan.sources import derived
from hearthspan.sources.tables import table
from hearthspan.session import scratch

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 8192

#: (partition column, bucket column, given tables, column of the first that becomes the bucket column) of each written input.
LAYOUT = {"sales": ("sale_year", "address_key", ("lineitem", "part"), "l_partkey")}

_written: dict[tuple, str] = {}


def stamp(spark: SparkSession, root: str, names: tuple[str, ...]) -> tuple:
    """What tells one state of the given tables from another: every file's path, length and time."""
    found = []
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{name}.parquet")
        found += [tuple(r) for r in files.select("path", "length", "modificationTime").collect()]
    return tuple(sorted(found))


def written_name(spark: SparkSession, root: str, name: str) -> str:
    """The name of the input's table: partitions prune by year, and grouping or joining by the bucket column needs no exchange.

    It is written when first asked for and again when a given table's files have changed; one copy serves a whole application.
    Buckets follow the number of rows, one for a million, and are never fewer than the cores, so that no stage runs narrower.
    """
    partition, bucket, given, dealt = LAYOUT[name]
    key = (spark.sparkContext.applicationId, root, name, stamp(spark, root, given))
    if key not in _written:
        source = table(spark, root, given[0])
        rows = source.count()
        buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS)))
        held = f"hearthspan_{name}_{uuid.uuid4().hex}"
        # the narrow given rows are dealt as the buckets are, before they are joined and widened: a task writes one bucket, a file a year
        out = derived.build(spark, root, name, tables={given[0]: source.repartition(buckets, F.col(dealt))})
        out.write.format("parquet").partitionBy(partition).bucketBy(buckets, bucket).sortBy(bucket).option("path", scratch(spark, name)).saveAsTable(held)
        _written[key] = held
    return _written[key]


def written(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The input as a table."""
    return spark.table(written_name(spark, root, name))
