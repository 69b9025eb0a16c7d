"""Declared schemas: no scan infers types, so no scan reads its input twice."""

from pyspark.sql import types as T

# The columns of the observation table.
MEASURES = (
    "temperature",
    "humidity",
    "precipitation",
    "pressure",
    "wind_speed",
    "soil_moisture",
)

# Source times are local wall-clock times without an offset, hence NTZ: the session
# time zone can neither move a row across a date nor across a split boundary.
OBSERVATIONS = T.StructType(
    [T.StructField("location", T.StringType()), T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(name, T.DoubleType()) for name in MEASURES]
)

SINGLE_SITE_OBSERVATIONS = T.StructType([f for f in OBSERVATIONS if f.name != "location"])

LOCATIONS = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# The columns of the event table.
EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("location", T.StringType()),
        T.StructField("hazard_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

# The weather service's field names and the column each one becomes.
HOURLY_FIELDS = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "pressure_msl": "pressure",
    "wind_speed_10m": "wind_speed",
    "soil_moisture_0_to_7cm": "soil_moisture",
}


def payload_schema(fields=None):
    """Schema of one raw document: an ``hourly`` object of parallel arrays."""
    names = list(fields or HOURLY_FIELDS)
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(name, T.ArrayType(T.DoubleType())) for name in names]
    return T.StructType([T.StructField("hourly", T.StructType(arrays))])
