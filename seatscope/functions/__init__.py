"""Column expressions: text, event times and review rules."""
