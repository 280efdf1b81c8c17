"""Questions in words, agent specs and glossaries."""
