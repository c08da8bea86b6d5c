"""Transformers, scorers, thresholds, detectors, aggregators and what is done with their results."""
