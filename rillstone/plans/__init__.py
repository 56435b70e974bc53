"""From text to plans: the SQL dialect with window clauses, and job files."""
