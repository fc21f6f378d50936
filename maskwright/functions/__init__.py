"""functions of the maskwright engine."""
