"""Emberline: alert-correlation analytics and corpus preparation as Spark DataFrame jobs."""
