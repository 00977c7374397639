"""Operators on texts for training data; nothing else in caseloom imports this."""
