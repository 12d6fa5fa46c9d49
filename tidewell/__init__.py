"""Environmental-quality evidence analytics as set-oriented Spark jobs."""
