"""Interval-meter analytics as Spark jobs: feeds, layers, star schema, reports, forecasts, anomalies."""
