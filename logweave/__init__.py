"""Log clustering and root-cause analytics as Spark DataFrame jobs."""
