"""Column functions: expressions over one row, no shuffle."""
