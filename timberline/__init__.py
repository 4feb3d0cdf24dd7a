"""Log search and analytics, and corpus preparation, as PySpark programs."""
