"""Query catalogue over the test tables."""
