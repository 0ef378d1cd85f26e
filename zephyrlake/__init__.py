"""Environmental-sensor analytics on Spark: scans, cleaning, alignment, indices, forecasts and their evaluation."""
