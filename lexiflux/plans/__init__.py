"""Plans shared by operators, and the catalogue of queries with their SQL."""
