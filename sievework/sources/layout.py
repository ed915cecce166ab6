"""Tables of findings laid out for the reads that they get: by organisation, and by id within it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path

BUCKETS = 16


def write_findings(findings: DataFrame, name: str | None = None, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """findings (finding_id, org_id, ..) as a table in folders by organisation and buckets by id, sorted by id, with Bloom filters.

    A filter on org_id reads that folder, one on finding_id its bucket, of which row groups that cannot hold the id are
    skipped. Rows are shuffled by bucket first, so a bucket of an organisation is one file.
    """
    import uuid

    spark = findings.sparkSession
    table = name or f"sievework_findings_{uuid.uuid4().hex}"
    writer = findings.repartition(buckets, "finding_id").write.format("parquet").partitionBy("org_id").bucketBy(buckets, "finding_id").sortBy("finding_id")
    writer = writer.option("parquet.bloom.filter.enabled#finding_id", "true").option("path", path or scratch_path(spark, "findings-table"))
    writer.saveAsTable(table)
    return spark.table(table)


def by_ids(table: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of some ids, as constants of the plan, so that only their buckets are read."""
    return table.where(F.col("finding_id").isin(*ids))
