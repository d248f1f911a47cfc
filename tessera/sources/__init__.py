"""Tables of vectors and of precomputed neighbours, in and out."""
