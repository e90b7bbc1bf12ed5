"""Reading and writing tables, reusable stages and fitted models."""
