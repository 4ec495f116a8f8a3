"""The query catalogue over the given tables, its SQL counterpart, and whole flows."""
