"""Point-in-time market-data research as Spark jobs."""
