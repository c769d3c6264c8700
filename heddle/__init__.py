"""heddle: a PySpark engine for keyed listing data and training-data pipelines."""
