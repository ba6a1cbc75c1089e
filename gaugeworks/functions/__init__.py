"""Column builders: text in, Column out, all on the JVM side."""
