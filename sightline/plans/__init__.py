"""Whole queries made of the operators, and the registry of those that the driver runs."""
