"""Registered reports: every operator bound to the test star and fixture parameters."""
