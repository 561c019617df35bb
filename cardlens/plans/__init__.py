"""Estimates and actuals of plans, feedback, correctors, join hints and filter bounds."""
