"""Column functions: exact clocks, rolling windows, publication calendars, scalars."""
