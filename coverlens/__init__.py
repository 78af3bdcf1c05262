"""Coverage analytics for a yes/no oversight flag, written as Spark DataFrame transformations."""
