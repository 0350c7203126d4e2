"""Table sources: the parquet test tables, derived views, file formats."""
