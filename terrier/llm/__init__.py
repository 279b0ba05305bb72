"""Training-data operators: each module holds one operator and the thin query that applies it."""
