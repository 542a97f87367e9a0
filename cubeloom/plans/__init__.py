"""Plan shapes shared by the operators."""
