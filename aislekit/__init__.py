"""aislekit: retail conversation data jobs written as PySpark DataFrames and Columns."""
