"""Sources: directory walk, table corpus, sub-directory listing, configuration."""
