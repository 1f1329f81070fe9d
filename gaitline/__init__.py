"""Behaviour analytics for animal-pose time series on Spark."""
