"""Log search, charting and ingestion expressed as Spark DataFrame plans."""
