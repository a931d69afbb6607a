"""Spark jobs for building an evidence-based record of events from large post collections."""
