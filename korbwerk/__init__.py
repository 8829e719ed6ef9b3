"""korbwerk: a PySpark engine for local retail offers and the savings plans built on them."""
