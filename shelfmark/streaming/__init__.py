"""The same pipeline over pages that arrive in batches."""
