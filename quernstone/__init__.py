"""Document tables, chunks, grounding and checks as Spark transformations."""
