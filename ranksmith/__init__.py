"""Game-record analytics on Spark: searches, explorers and batch jobs as DataFrame plans."""
