"""tidemill: streaming-analytics operators for PySpark, declared with the DataFrame and SQL API."""
