"""Column functions of the document engine."""
