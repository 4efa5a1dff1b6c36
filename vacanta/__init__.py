"""A PySpark engine for job-posting data."""
