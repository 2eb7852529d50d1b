"""Physical patterns that the planner lacks, and rewrites of idioms into plans that it has."""
