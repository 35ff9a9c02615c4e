"""Table access (SRC-1 .. SRC-4) and the calendar dimension (DT-3)."""
