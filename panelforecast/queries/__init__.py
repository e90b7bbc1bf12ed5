"""Queries over the given tables, each with equivalent SQL where SQL can say it."""
