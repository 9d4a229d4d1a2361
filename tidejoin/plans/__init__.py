"""Specifications of joins, and experiments over them."""
