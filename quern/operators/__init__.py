"""Part of Quern."""
