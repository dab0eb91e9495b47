"""Column functions; all but those marked so run inside the JVM."""
