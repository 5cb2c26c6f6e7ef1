"""The query language and how its queries become frames."""
