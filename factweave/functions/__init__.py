"""Column functions: values and periods, decimal arithmetic, text, contact fields."""
