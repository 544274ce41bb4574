"""FlakeSpark plans."""
