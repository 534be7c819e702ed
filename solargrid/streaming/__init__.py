"""streaming of the solar mapping engine."""
