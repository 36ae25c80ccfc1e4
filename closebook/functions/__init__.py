"""Column functions for money, text and redaction."""
