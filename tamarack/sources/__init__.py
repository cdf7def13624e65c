from tamarack.sources.arrow_ipc import save_arrow, scan_arrow, scan_arrow_report, stream_arrow
from tamarack.sources.census import file_census, schema_conflicts, schema_groups, usable_paths
from tamarack.sources.prompts import default_suite, load_prompts, prompts_json
from tamarack.sources.scan import (
    chunk_report,
    newest_shards,
    read_source_tree,
    scan_chunks,
    scan_corpus,
    scan_tolerant,
    scan_tolerant_report,
    spread,
    take_first,
)
from tamarack.sources.sinks import (
    append_run_metadata,
    materialize,
    save_corpus,
    write_eval_detail,
    write_summary_text,
)

__all__ = [
    "append_run_metadata",
    "chunk_report",
    "default_suite",
    "file_census",
    "load_prompts",
    "materialize",
    "newest_shards",
    "prompts_json",
    "read_source_tree",
    "save_arrow",
    "save_corpus",
    "scan_arrow",
    "scan_arrow_report",
    "scan_chunks",
    "scan_corpus",
    "scan_tolerant",
    "scan_tolerant_report",
    "schema_conflicts",
    "schema_groups",
    "spread",
    "stream_arrow",
    "take_first",
    "usable_paths",
    "write_eval_detail",
    "write_summary_text",
]
