"""Running the same stages and panels on streams."""
