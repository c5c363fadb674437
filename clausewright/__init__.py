"""Spark-first analytics over request documents, requirements and manual evidence."""
