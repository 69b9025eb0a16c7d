from freshet.catalog import (  # noqa: F401  (importing registers the queries)
    evaluation_queries,
    feature_queries,
    model_queries,
    source_queries,
)
from freshet.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
