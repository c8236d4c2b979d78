"""Hybrid retrieval, situation analytics and corpus preparation as Spark plans."""
