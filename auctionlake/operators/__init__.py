"""Table operators: keys, merges, windows, fuzzy and spatial joins."""
