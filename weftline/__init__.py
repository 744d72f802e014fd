"""Behaviour analysis of system traces as Spark jobs."""
