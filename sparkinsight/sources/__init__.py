"""Readers (CSV with inference, SQLite data source, text, binary hash), fragment
union and the Parquet metadata catalog."""
