"""Column-level helpers: month codec, ratios, fills, predicate lists."""
