"""Physical-shape helpers: skew-safe joins and orderings, tiled scoring, dense ids."""
