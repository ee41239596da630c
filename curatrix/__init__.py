"""A PySpark library for putting large catalogues in order."""
