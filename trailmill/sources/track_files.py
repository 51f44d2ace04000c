"""Track files of other collections as tables of points: ``file, lat, lng, ts`` (milliseconds), ``heading, speed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines before the points of a PLT file, and what is told of points without heading and speed.
PLT_HEADER, PLT_HEADING, PLT_SPEED = 6, 0.0, 1.2
PLT_FIELDS, EV_FIELDS = 7, 12


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line``: lines numbered from 1 in each file. A file is read whole by one task: these are
    single trips."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def read_plt(spark: SparkSession, path: str, zone: str = "UTC") -> DataFrame:
    """PLT files: after the header lines latitude, longitude, two unused numbers, days, date and time.
    Lines of too few fields, or without numbers or a time where they should be, are left out."""
    f = _lines(spark, path).filter(F.col("n") > PLT_HEADER).withColumn("f", F.split("line", ",")).filter(F.size("f") >= PLT_FIELDS)
    at = F.try_to_timestamp(F.concat_ws(" ", F.get("f", F.lit(5)), F.get("f", F.lit(6))), F.lit("yyyy-MM-dd HH:mm:ss"))
    p = f.select("file", F.trim(F.get("f", F.lit(0))).try_cast("double").alias("lat"), F.trim(F.get("f", F.lit(1))).try_cast("double").alias("lng"), F.unix_millis(F.to_utc_timestamp(at, zone)).alias("ts"))
    return p.dropna().select("*", F.lit(PLT_HEADING).alias("heading"), F.lit(PLT_SPEED).alias("speed"))


def read_ev(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of electric vehicles: after one header line vehicle, number, time in milliseconds, local
    time, latitude, longitude, speed, heading, accuracy, two states and odometer. Bad lines are left out."""
    f = _lines(spark, path).filter(F.col("n") > 1).withColumn("f", F.split("line", ",")).filter(F.size("f") >= EV_FIELDS)
    number = lambda i, kind="double": F.trim(F.get("f", F.lit(i))).try_cast(kind)
    return f.select("file", number(4).alias("lat"), number(5).alias("lng"), number(2, "long").alias("ts"), number(7).alias("heading"), number(6).alias("speed")).dropna()
