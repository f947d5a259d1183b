"""Column expressions on reads; all stay inside the JVM."""
