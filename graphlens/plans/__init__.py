"""Query plans made of several operators, and the storage between their steps."""
