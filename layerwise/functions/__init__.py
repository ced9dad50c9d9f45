"""Column functions and response parsers."""
