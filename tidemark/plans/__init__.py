"""Signal graphs, gradients and training of the signal engine."""
