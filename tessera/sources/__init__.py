"""File and table readers."""
