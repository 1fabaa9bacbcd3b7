"""Query catalogue: operators bound to tables, with their SQL counterparts."""
