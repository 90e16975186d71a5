"""Column-level building blocks.  Nothing here shuffles: every function maps one row to one value."""
