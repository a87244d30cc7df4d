"""From program text to a checked syntax tree and to the decision how to run it."""
