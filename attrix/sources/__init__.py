from attrix.sources.readers import Snapshot, SourceError, read_csv, read_parquet, read_table

__all__ = ["Snapshot", "SourceError", "read_csv", "read_parquet", "read_table"]
