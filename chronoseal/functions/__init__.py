"""Column expressions. Built-in Spark functions unless a docstring says otherwise."""
