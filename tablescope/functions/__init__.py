"""Column-level building blocks: type rules, guarded statistics, score expressions."""
