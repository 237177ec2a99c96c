"""Build competing forecasts of two-sided contests and score them on Spark."""
