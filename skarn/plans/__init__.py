"""Session set-up, stage tables and skew helpers shared by all operators."""
