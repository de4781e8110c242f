"""Column functions of the topic operators."""
