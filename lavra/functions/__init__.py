"""Column functions over text, all on the JVM side."""
