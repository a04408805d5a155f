"""Column-level operators: units, instants, durations, complex numbers, collections."""
