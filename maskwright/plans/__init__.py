"""plans of the maskwright engine."""
