"""Column-level building blocks (text keys, predicates, keyword trees)."""
