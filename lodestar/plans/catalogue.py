"""All modules that register queries."""

from lodestar.plans import aggregate_queries, annotation_queries, cell_queries, filter_queries, graph_queries, kg_queries, model_queries, peak_queries, range_queries, screen_queries, table_queries, text_queries, window_queries  # noqa: F401
