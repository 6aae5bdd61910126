"""Column expressions (JVM side) and the few Arrow functions Spark has no expression for."""
