"""Vector search and analytics on PySpark DataFrames."""
