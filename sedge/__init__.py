"""sedge: text-heavy analytics on PySpark DataFrames."""
