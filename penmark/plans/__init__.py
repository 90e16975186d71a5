"""Registered queries: each module maps a name to a Spark plan over the given tables, and, where
SQL can express the result, to an independent SQL statement used as its check."""
