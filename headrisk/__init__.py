"""Mail-header risk analytics as Spark jobs."""
