"""The same reports over streams."""
