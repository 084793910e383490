"""Tidemill: a Spark-first engine for conformed, tested and metric-ready tables."""
