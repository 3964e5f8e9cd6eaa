"""Plan helpers shared by the operators: ordered access without one task per
key, exact quantiles, grid joins, as-of brackets, components and trial tables."""
