"""Column-to-column functions: everything here stays inside the JVM."""
