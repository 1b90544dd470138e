"""Activity and memory-graph analytics as set-at-a-time Spark operators."""
