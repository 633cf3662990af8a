"""Profiling, statistics, baseline models and forecasts over tables, as Spark jobs."""
