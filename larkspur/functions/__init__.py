"""Functions of expressions and of Spark columns."""
