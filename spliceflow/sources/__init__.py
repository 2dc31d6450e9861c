"""Tables the operators work on, and readers and writers of their file formats."""
