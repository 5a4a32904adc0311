"""A catalogue engine for items on Spark."""
