"""Type predicates, reusable column expressions and scratch storage."""
