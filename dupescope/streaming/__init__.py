"""Progress events as batch and streaming queries."""
