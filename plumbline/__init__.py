"""Entity-deviation analytics on Spark."""
