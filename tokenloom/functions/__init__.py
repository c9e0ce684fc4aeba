"""Column-level functions (JVM-side expressions, codegen friendly)."""

from tokenloom.functions.hashing import h48, u01  # noqa: F401
