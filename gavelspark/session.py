"""A session with the settings that the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "gavelspark", **settings: str) -> SparkSession:
    """settings: further Spark settings, dots written as double underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
