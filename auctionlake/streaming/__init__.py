"""Incremental, idempotent runs of the batch operators on streams."""
