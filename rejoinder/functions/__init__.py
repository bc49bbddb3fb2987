"""Column functions and the model-client protocol."""
