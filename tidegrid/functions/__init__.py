"""Column expressions: calendar, geometry, flags, Skellam mass and distribution."""
