"""Plan-shape helpers: checkpoints, exact order statistics, ordered ranges."""
