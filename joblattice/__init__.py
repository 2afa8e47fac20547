"""Data work of a job-matching service, written as Spark DataFrame jobs."""
