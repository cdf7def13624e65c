from tamarack.functions.labels import duration_label, progress_bar, rate_label, run_name
from tamarack.functions.order import epoch_micros, hash_order, hash_prefix
from tamarack.functions.text import contains_any, contains_marker, markers_found, parse_fractions

__all__ = [
    "contains_any",
    "contains_marker",
    "duration_label",
    "epoch_micros",
    "hash_order",
    "hash_prefix",
    "markers_found",
    "parse_fractions",
    "progress_bar",
    "rate_label",
    "run_name",
]
