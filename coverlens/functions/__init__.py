"""Column expressions: every function maps columns to a column and runs inside the JVM unless it says otherwise."""
