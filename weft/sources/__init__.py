"""Where alignments and tables come from."""
