"""Whole commands as plans: detect, analyse, evaluate."""
