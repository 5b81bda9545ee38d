"""Schema-free queries over raw JSON text, in DataFrame operations."""
