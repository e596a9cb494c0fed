"""Column expressions (JVM-side, no Python per row)."""
