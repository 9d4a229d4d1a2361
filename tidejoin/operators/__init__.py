"""Batch operators: joins, statistics of a run, partitioning and power analytics."""
