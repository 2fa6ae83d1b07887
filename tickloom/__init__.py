"""Market-data, news and corpus jobs on Spark."""
