"""lodestar: a Spark-first analytics engine for annotated, interval-indexed and graph-shaped tables."""

__all__ = ["session"]
