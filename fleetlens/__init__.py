"""Fleet-wide monitoring analytics for database estates, as PySpark DataFrame jobs."""
