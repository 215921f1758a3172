"""Independent SQL statements of every checked query, for the correctness gate."""
