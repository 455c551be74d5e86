"""Language-aware text normalization as Spark columns."""
