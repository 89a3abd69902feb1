"""End-to-end plans (detect, experiment, recovery, scan) and the registry of
driver queries with their DuckDB oracle SQL."""
