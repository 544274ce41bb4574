"""FlakeSpark sources."""
