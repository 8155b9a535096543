"""Fixtures derived from the star schema, and the registered queries over them."""
