"""Question plans over query tables, and the queries that the driver runs."""
