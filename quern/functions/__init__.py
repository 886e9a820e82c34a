"""Part of the quern engine."""
