"""Column functions: everything here stays in one row and needs no shuffle."""
