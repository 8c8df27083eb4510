"""Point-in-time market and evidence analytics on Spark."""
