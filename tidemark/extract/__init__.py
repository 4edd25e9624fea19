"""Facts of source files, and their resolution into an index."""
