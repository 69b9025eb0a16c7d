from freshet.sources.models import load_model, save_model
from freshet.sources.observations import tag_location, unpack_hourly
from freshet.sources.tables import (
    quarantine,
    read_csv,
    read_events,
    read_observations,
    read_table,
    replace_partitions,
    write_csv,
    write_table,
)

__all__ = [
    "load_model",
    "quarantine",
    "read_csv",
    "read_events",
    "read_observations",
    "read_table",
    "replace_partitions",
    "save_model",
    "tag_location",
    "unpack_hourly",
    "write_csv",
    "write_table",
]
