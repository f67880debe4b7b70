"""Training-data operators: one module each, registered in `registry`."""
