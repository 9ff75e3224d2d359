"""The session that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC instants, timestamps with Parquet statistics, and quoted identifiers as the standard has them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configured(spark: SparkSession) -> SparkSession:
    """The session, with the library's SQL settings."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def request_session(spark: SparkSession) -> SparkSession:
    """A session of its own for one request: it sees no views and opens no files by name."""
    from .functions.time_bucket import register_time_bucket

    session = configured(spark.newSession())
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    register_time_bucket(session)
    return session
