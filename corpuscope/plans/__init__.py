"""Plan building blocks shared by the operators: lineage cuts, skew-proof joins,
distributed running totals and blocked containment joins."""
