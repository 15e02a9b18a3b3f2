"""The analyses of the case table, put together from the operators."""
