"""Part of unitloom."""
