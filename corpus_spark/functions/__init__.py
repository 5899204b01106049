"""Column functions: text cleaning, dates, language rules, list fields."""
