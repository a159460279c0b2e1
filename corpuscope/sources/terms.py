"""Stop-term lists and thesaurus files.

A thesaurus file holds a key per line, followed by its values indented by four
spaces.  It is read line by line, so a file larger than one task is no problem.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import materialise
from ..plans.running import running

INDENT = "    "


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed term per line as ``term``; blank lines are ignored."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''")


def _ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the columns that order them: file, block of the file, row in the block."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        F.regexp_replace("value", r"\s+$", "").alias("line"),
    )


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """Read a thesaurus as ``(canonical, variant)``.

    Raises ``ValueError`` when a key has no values or a value comes before any key.
    """
    lines = _ordered_lines(spark, path).where("line <> ''")
    is_key = ~F.col("line").startswith(" ")
    order = [F.col("_file"), F.col("_block"), F.col("_row")]
    lines = lines.withColumns({"_is_key": is_key, "_text": F.trim("line")})
    filled = materialise(
        running(
            lines,
            [],
            order,
            latest={"_last": F.when(F.col("_is_key"), F.struct("_file", "_block", "_row", "_text"))},
        ).select("_is_key", "_text", "_last")
    )
    # A key is bare when no value line refers to its position.
    bare = (
        filled.groupBy("_last")
        .agg(F.count_if(~F.col("_is_key")).alias("_values"))
        .where((F.col("_values") == 0) | F.col("_last").isNull())
        .take(1)
    )
    if bare:
        last = bare[0]["_last"]
        if last is None:
            raise ValueError("thesaurus value without a key")
        raise ValueError(f"thesaurus key without values: {last['_text']}")
    return filled.where(~F.col("_is_key")).select(
        F.col("_last._text").alias("canonical"), F.col("_text").alias("variant")
    )


def write_thesaurus(df: DataFrame, path: str, fmt: str = "text") -> None:
    """Write ``(canonical, variant)`` sorted by key, as a thesaurus file or as parquet."""
    pairs = df.select("canonical", "variant").distinct()
    if fmt == "parquet":
        pairs.sort("canonical", "variant").write.parquet(path)
        return
    keys = pairs.select("canonical").distinct().select(
        "canonical", F.lit(0).alias("_kind"), F.col("canonical").alias("line")
    )
    values = pairs.select(
        "canonical", F.lit(1).alias("_kind"), F.concat(F.lit(INDENT), "variant").alias("line")
    )
    keys.unionByName(values).sort("canonical", "_kind", "line").select("line").write.text(path)
