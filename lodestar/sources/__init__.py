"""Where collections are kept."""
