"""The event schema and the normalisation of new events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _TIME, _INT = T.StringType(), T.TimestampType(), T.IntegerType()
_OBJECT = _struct(kind=_TEXT, namespace=_TEXT, name=_TEXT, uid=_TEXT, apiVersion=_TEXT, resourceVersion=_TEXT, fieldPath=_TEXT)
EVENT_SCHEMA = _struct(
    kind=_TEXT,
    apiVersion=_TEXT,
    metadata=_struct(name=_TEXT, namespace=_TEXT, uid=_TEXT, resourceVersion=_TEXT, creationTimestamp=_TIME),
    involvedObject=_OBJECT,
    reason=_TEXT,
    message=_TEXT,
    source=_struct(component=_TEXT, host=_TEXT),
    firstTimestamp=_TIME,
    lastTimestamp=_TIME,
    count=_INT,
    type=_TEXT,
    eventTime=_TIME,
    series=_struct(count=_INT, lastObservedTime=_TIME),
    action=_TEXT,
    related=_OBJECT,
    reportingComponent=_TEXT,
    reportingInstance=_TEXT,
)
KEY = "metadata.resourceVersion"
TIME = "lastTimestamp"


def _missing(name: str) -> Column:
    """A time that is null or the zero time of the source (year 1)."""
    return F.col(name).isNull() | (F.col(name) <= F.lit("0001-01-01 00:00:00").cast("timestamp"))


def normalise(events: DataFrame) -> DataFrame:
    """Fill a missing first time from the creation time, then a missing last time from the first, and count 0 by 1."""
    created = F.col("metadata.creationTimestamp")
    out = events.withColumn("firstTimestamp", F.when(_missing("firstTimestamp"), created).otherwise(F.col("firstTimestamp")))
    out = out.withColumn(TIME, F.when(_missing(TIME), F.col("firstTimestamp")).otherwise(F.col(TIME)))
    return out.withColumn("count", F.when(F.coalesce("count", F.lit(0)) == 0, F.lit(1)).otherwise(F.col("count")))


def conform(events: DataFrame) -> DataFrame:
    """The columns and nested fields of the schema, by name and in its order; those that are absent are null."""

    def fitted(path: str, kind: T.DataType, held: T.StructType, name: str) -> Column:
        if name not in held.names:
            return F.lit(None).cast(kind).alias(name)
        if not isinstance(kind, T.StructType):
            return F.col(path).cast(kind).alias(name)
        inner = F.struct(*[fitted(f"{path}.{f.name}", f.dataType, held[name].dataType, f.name) for f in kind])
        return F.when(F.col(path).isNotNull(), inner).alias(name)

    return events.select(*[fitted(f.name, f.dataType, events.schema, f.name) for f in EVENT_SCHEMA])
