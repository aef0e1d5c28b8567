"""lakemill: a relational analytics engine expressed as PySpark plans."""
