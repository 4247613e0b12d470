"""weftline: Spark-first preparation and scoring of argument-graph data."""
