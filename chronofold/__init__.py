"""Point-in-time history analytics on Spark."""
