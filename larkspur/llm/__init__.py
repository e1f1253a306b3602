"""Operators that prepare training text at scale, each one a set of Spark jobs."""
