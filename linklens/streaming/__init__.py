"""Row-level operators on streaming DataFrames."""
