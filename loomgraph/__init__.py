"""Skill-graph matching, ranking and ingestion as PySpark plans."""
