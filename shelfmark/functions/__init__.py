"""Column functions: text, URLs and prices."""
