"""vitrail: page-capture analytics on Spark."""
