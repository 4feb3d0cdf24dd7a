"""Parameterised queries over tables of log rows."""
