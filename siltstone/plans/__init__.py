"""Evidence analytics: plans."""
