"""Stateful and model operators of the signal engine."""
