"""frostline: a Spark-first engine for item cold-start ranking and corpus analytics."""
