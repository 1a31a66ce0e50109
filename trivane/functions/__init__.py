"""Column functions: the three-valued algebra, bit gates, logical clocks and masks."""
