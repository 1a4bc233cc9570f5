"""Spark-first analytics for multi-date, multi-band raster observations."""
