"""DuckDB oracle SQL for every query in ``__spark_entry__.queries()``."""
