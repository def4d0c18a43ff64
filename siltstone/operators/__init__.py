"""Evidence analytics: operators."""
