"""Radio-coverage analytics as Spark DataFrame jobs."""
