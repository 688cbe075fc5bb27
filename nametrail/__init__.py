"""DNS query-log analytics as Spark DataFrame jobs."""
