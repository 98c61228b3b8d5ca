"""Staffing and FTE reporting as Spark jobs."""
