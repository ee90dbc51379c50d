"""Column functions, lookup values and the few Python functions."""
