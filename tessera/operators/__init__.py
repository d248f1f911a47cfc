"""The stages of the clustering pipeline, each a DataFrame operator of its own."""
