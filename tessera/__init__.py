"""Change and coupling analytics over fact tables."""
