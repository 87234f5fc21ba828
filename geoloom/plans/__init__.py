"""Named queries over the star-schema tables, each with the SQL that yields the same rows."""
