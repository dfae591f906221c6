"""Plan building blocks: skew-safe joins, distributed running totals, lineage cuts."""
