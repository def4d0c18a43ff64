"""Evidence analytics: streaming."""
