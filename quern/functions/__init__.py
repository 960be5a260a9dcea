"""Column functions: text, hashing and encryption, JSON columns, tokens, and row validation. All run inside the JVM unless a docstring says otherwise."""
