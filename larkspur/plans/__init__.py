"""Named queries over the relational tables."""
