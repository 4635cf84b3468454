from .points import (
    duplicate_ids, format_points, parse_points, points_from_table, read_text_points,
    sample_head, sample_random, stream_table_points, stream_text_points,
)
from .reports import console_sink, report_lines, table_sink, write_report

__all__ = [
    "console_sink", "duplicate_ids", "format_points", "parse_points", "points_from_table",
    "read_text_points", "report_lines", "sample_head", "sample_random",
    "stream_table_points", "stream_text_points", "table_sink", "write_report",
]
