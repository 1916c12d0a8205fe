"""Query plan builders: nearest neighbours, full text, fusion, search."""
