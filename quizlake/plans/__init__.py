"""Input views over the given tables, the query catalogue and its oracle SQL."""
