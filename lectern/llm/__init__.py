"""Training-data operators. Nothing outside this folder imports it; delete it and the rest still works."""
