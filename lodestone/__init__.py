"""Analytics on collections of official notices, on Spark."""
