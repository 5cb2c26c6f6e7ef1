"""Vector similarity analytics on Spark: collections, exact and approximate search, filters, aggregates."""
