"""Plan helpers: lineage cuts, checked broadcasts and table access."""
