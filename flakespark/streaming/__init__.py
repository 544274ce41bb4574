"""FlakeSpark streaming."""
