"""Quarry: declarative dataset analytics as Spark DataFrame jobs."""
