"""operators of the solar mapping engine."""
