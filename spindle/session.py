"""Sessions with the settings the library is written for."""

from pyspark.sql import SparkSession


def session(name: str = "spindle", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has further settings, with _ for the dots of their names."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
