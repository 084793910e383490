"""Metric compiler, model registry, quality, graph and cost plans."""
