"""Points that arrive as a stream."""
