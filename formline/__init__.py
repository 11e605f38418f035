"""Point-in-time sports-outcome analytics expressed as Spark DataFrame jobs."""
