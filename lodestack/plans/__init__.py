"""Query catalogue and pipelines built from the operators."""
