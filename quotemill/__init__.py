"""quotemill: a PySpark-native analytics engine for bid/ask tick data."""
