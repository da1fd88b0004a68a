"""Panel analytics on Spark: units measured against items, with feature profiles on either side."""
