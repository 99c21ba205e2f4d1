"""Column functions: URLs, text, dates, taxonomy."""
