"""FlakeSpark operators."""
