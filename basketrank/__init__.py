"""Retail ranking analytics as PySpark DataFrame jobs."""
