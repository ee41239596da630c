"""Where files, tags and mappings come from, and where reports go."""
