"""Analytics for large collections of neural recordings on Spark."""
