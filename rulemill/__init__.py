"""Decision-rule mining and corpus analytics on Spark."""
