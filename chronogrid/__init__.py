"""chronogrid: behavioural time-series analytics as PySpark DataFrame jobs."""
