"""Sources (S1-S7) and sinks (K1-K7)."""
