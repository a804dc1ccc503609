"""The study from end to end, composed of the operators."""
