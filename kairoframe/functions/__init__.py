"""Column expressions on texts, wall clocks, dates and the lunar calendar."""
