"""Column functions: every one maps Columns to Columns and stays on the JVM."""
