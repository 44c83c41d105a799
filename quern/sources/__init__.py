"""Where logs are kept: append-only Parquet segments, backups, offset-ordered reads."""
