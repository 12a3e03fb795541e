"""Parts-catalogue analytics on Spark."""
