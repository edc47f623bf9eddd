"""A PySpark engine for event-ordered competition and ranking data."""
