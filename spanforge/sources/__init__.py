"""Where graph tables come from and go to."""
