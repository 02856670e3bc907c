"""Text files as they arrive: new ones are converted once, old ones are left alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.csv_ingest import typed, with_file_name, write_by_file
from tessella.sources.formats import FORMATS, CsvFormat

HOUR = r"(?<!\d)(\d{10})(?!\d)"


def file_hour(name: Column) -> Column:
    """The hour that ten digits in a file's name say (yyyyMMddHH); null without."""
    base = F.substring_index(name, "/", -1)
    return F.try_to_timestamp(F.nullif(F.regexp_extract(base, HOUR, 1), F.lit("")), F.lit("yyyyMMddHH"))


def not_late(name: Column, now: Column, lookback_days: int = 30) -> Column:
    """Whether a file's hour lies within the last days; files without an hour do not."""
    return F.coalesce(file_hour(name) >= now - F.make_interval(days=F.lit(lookback_days)), F.lit(False))


def pending_files(files: DataFrame, done: DataFrame, now: Column, lookback_days: int = 30) -> DataFrame:
    """files (path) that are not late and whose base name is not in done (file)."""
    base = F.regexp_extract(F.substring_index("path", "/", -1), r"^([^.]*)", 1)
    return files.where(not_late(F.col("path"), now, lookback_days)).withColumn("file", base).join(done.select("file"), "file", "left_anti")


def ingest(spark: SparkSession, glob: str, out_dir: str, checkpoint: str, fmt: CsvFormat | str, lookback_days: int = 30, every: str | None = None, per_batch: int = 1000, now: Column | None = None):
    """Starts the stream and returns its query.

    The checkpoint knows which files were read; a batch that runs again
    replaces what it wrote, file by file.  Without ``every`` it ends when all
    files that are there are converted, else it looks again that often
    ('1 hour').
    """
    fmt = FORMATS[fmt] if isinstance(fmt, str) else fmt
    folder, _, pattern = glob.rpartition("/")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fmt.fields])
    source = spark.readStream.schema(schema).options(sep=fmt.sep, header=fmt.header, pathGlobFilter=pattern, maxFileAge=f"{lookback_days}d", maxFilesPerTrigger=per_batch).csv(folder)
    fresh = source.where(not_late(F.col("_metadata.file_name"), now if now is not None else F.current_timestamp(), lookback_days))

    def write(batch: DataFrame, _: int) -> None:
        write_by_file(typed(batch, fmt), out_dir)

    writer = with_file_name(fresh).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
