"""Quern: declarative models, an immutable query builder and mutable snapshot tables on Spark."""
