"""Importing this registers every query."""

from . import q_cells, q_charts, q_factor, q_forms, q_market, q_more, q_reports, q_research, q_shapes, q_stats, q_streams, q_tables, q_time, q_windows  # noqa: F401
