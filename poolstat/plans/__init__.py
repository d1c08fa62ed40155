"""Registered queries by family: each module's QUERIES maps a name to (query, the SQL it must equal or None)."""
