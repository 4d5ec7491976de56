"""Tidal-flat scene and tide analytics expressed as Spark DataFrame jobs."""
