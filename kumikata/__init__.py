"""Analytics for competition and event-sequence data on PySpark."""
