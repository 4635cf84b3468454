"""Building blocks: partitioning, similarity joins, neighbour lists, windows."""
