"""Plans that iterate: levels of a graph, propagation, closures."""
