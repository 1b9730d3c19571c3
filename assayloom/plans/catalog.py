"""All registered queries."""

from assayloom.plans import (  # noqa: F401
    flagship,
    hts_queries,
    interval_queries,
    io_queries,
    sequence_queries,
    stat_queries,
    table_queries,
)
from assayloom.plans.registry import ORACLES, QUERIES  # noqa: F401
