"""Column functions: normalisation, classes of characters, hashes as random numbers, spans."""
