"""DataFrame-to-DataFrame operators; origin, horizon and scenario are always columns."""
