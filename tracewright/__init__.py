"""Tracewright: lifecycle analytics for collaborative software projects, on Spark DataFrames."""
