"""Vector and text retrieval analytics on Spark."""
