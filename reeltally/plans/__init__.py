"""Plan helpers shared by the operators: ordered blocks, range joins, verdicts."""
