"""Column functions: no DataFrame, no action, no shuffle."""
