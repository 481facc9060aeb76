"""Plans: whole queries put together from the operators."""
