"""Column expressions: text cleaning, guarded arithmetic, curves, draw paths."""
