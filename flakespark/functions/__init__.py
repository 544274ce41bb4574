"""FlakeSpark functions."""
