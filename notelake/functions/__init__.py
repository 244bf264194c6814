"""Column functions; all run in the JVM but the ones in ``python``."""
