"""Plan-level building blocks: lineage cuts, components, shipping the package."""
