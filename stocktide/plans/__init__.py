"""Named queries over the driver's tables, each with its DuckDB counterpart."""
