"""Named queries over the given tables, each with equivalent SQL where SQL can express it."""
