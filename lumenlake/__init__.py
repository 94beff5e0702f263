"""Media-library analytics and corpus preparation as Spark jobs."""
