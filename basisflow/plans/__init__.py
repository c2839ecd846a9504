"""Plan-level helpers shared by the operators: lineage, ordered dedupe, exact order statistics."""
