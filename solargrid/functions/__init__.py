"""functions of the solar mapping engine."""
