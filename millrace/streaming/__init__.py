"""Streaming aggregates and learners that are updated batch by batch."""
