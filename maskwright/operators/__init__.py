"""operators of the maskwright engine."""
