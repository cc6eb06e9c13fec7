"""Sources and sinks: parquet/CSV/JSON scans, canonical article loading, writers."""
