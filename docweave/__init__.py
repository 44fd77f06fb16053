"""docweave: span-addressed document and record analytics on plain PySpark."""
