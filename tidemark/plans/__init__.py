"""How reads of the log are planned."""
