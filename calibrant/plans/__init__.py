"""Reports, betting results, and the catalog of queries with their SQL counterparts."""
