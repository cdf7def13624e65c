from tamarack.streaming.jobs import (
    STATEFUL_BYTES,
    incremental_ingest,
    marker_alerts,
    moving_average,
    progress_windows,
    read_stream,
    run_available,
    throttle,
)
from tamarack.streaming.unordered import (
    moving_average_unordered,
    run_counting_late,
    stateful_session,
    throttle_unordered,
)

__all__ = [
    "STATEFUL_BYTES",
    "incremental_ingest",
    "marker_alerts",
    "moving_average",
    "moving_average_unordered",
    "progress_windows",
    "read_stream",
    "run_available",
    "run_counting_late",
    "stateful_session",
    "throttle",
    "throttle_unordered",
]
