"""Column expressions: take columns, return columns, need no shuffle."""
