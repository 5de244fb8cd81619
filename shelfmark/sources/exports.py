"""The contents sheet of every folder: its documents, then its subfolders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_contents(documents: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, kind_ord, File, Summary) for every folder that holds something.

    Documents have ``kind_ord`` 0 and come first, subfolders have 1.
    """
    in_folder = documents.select(
        "folder", F.lit(0).alias("kind_ord"), F.col("name").alias("File"),
        F.col("summary").alias("Summary"),
    )
    below = folders.where(F.col("parent").isNotNull()).select(
        F.col("parent").alias("folder"), F.lit(1).alias("kind_ord"), F.col("name").alias("File"),
        F.col("summary").alias("Summary"),
    )
    return in_folder.unionByName(below)


def export_contents(
    documents: DataFrame, folders: DataFrame, out: str, per_folder: bool = False
) -> None:
    """Write the contents sheets to ``out``, in place of an older export.

    As one table clustered by folder, so that reading one folder touches few files. With
    ``per_folder`` each folder gets a directory of its own, which suits small trees.
    """
    sheet = folder_contents(documents, folders)
    if per_folder:
        sheet.write.mode("overwrite").partitionBy("folder").parquet(out)
        return
    order = ("folder", "kind_ord", "File")
    sheet.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(out)
