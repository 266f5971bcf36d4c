"""tallyloom: corpus building and corpus analytics expressed as Spark DataFrame jobs."""
