"""Column functions: framed windows, rolling features, recursive averages."""
