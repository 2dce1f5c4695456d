"""Jobs (silver, gold), the registered queries and their DuckDB twins."""
