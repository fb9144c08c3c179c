"""Column functions: text, dates and records."""
