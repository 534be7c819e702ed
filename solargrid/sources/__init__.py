"""sources of the solar mapping engine."""
