"""Planning: predicates over relationships, and paths shared between expressions."""
