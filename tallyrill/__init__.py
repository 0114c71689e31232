"""A PySpark-native analytics engine: a strictly typed table language over versioned
Parquet snapshots, and market time-series analytics."""
