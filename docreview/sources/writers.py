"""Writers. Tables are partitioned by project and bidder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreview.constants import BIDDER
from docreview.sources.store import ResultStore


def write_sections(section_rows: DataFrame, path: str) -> None:
    """The section index. Sorted inside each file and without any timestamp: the same input gives
    the same content."""
    (
        section_rows.repartition(*BIDDER, "file_no")
        .sortWithinPartitions(*BIDDER, "file_no", "seq")
        .write.mode("overwrite").partitionBy(*BIDDER).parquet(path)
    )


def write_results(results: DataFrame, path: str, run_no: int) -> None:
    """One run's results into the store at `path`; see `sources.store`."""
    ResultStore(results.sparkSession, path).write(results, run_no)


def upsert_results(batch: DataFrame, batch_id: int, path: str) -> None:
    """`foreachBatch` body: one version per batch, written anew when the batch is replayed."""
    ResultStore(batch.sparkSession, path).write(batch, batch_id)


def project_manifest(section_rows: DataFrame) -> DataFrame:
    return section_rows.groupBy(*BIDDER).agg(
        F.first("bidder").alias("name"),
        F.count("*").alias("sections"), F.sum("char_len").alias("chars"),
    )


def write_manifest_if_absent(section_rows: DataFrame, path: str) -> None:
    """The manifest of a project from its sections. An existing one is left as it is."""
    project_manifest(section_rows).write.mode("ignore").parquet(path)


def write_report_blocks(blocks: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per report block."""
    for name, block in blocks.items():
        block.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """The six hand-over tables as CSV with headers."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").option("header", True).option("escape", '"').csv(
            f"{path.rstrip('/')}/{name}"
        )
