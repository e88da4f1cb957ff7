"""Spark-first analytics over network measurement streams."""
