"""Column functions: scalars, labels, vectors, rings, tokens; polygon kernels for what columns cannot express."""
