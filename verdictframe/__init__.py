"""Policy analytics on Spark: rules compiled to DataFrame columns, single-pass dataset aggregates and governance."""
