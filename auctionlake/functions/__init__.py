"""Column functions: text, amounts, dates, numbers and geometry."""
