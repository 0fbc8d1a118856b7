"""Column-level building blocks: scalar expressions, rolling frames, statistics."""
