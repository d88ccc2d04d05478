"""Volumetric image and point analytics as Spark DataFrame jobs."""
