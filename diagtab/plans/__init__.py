"""Composed plans: corpus reports and the stand-in views over the test tables."""
