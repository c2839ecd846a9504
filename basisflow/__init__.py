"""Price-risk and hedge analytics as PySpark DataFrame jobs."""
