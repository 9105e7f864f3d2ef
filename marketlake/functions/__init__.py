"""Column expressions: plain functions that return Columns, so that the optimiser sees all of them."""
