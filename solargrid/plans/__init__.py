"""plans of the solar mapping engine."""
