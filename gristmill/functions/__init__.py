"""Column functions: text, URLs, classification, control arithmetic."""
