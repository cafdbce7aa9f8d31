"""Company-news analytics on Spark: batch-first, every company in one lazy plan."""
