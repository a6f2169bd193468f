"""Code-quality analytics on Spark."""
