"""Column-expression builders (URL, text) used by the operators."""
