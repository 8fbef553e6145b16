"""Jobs that chain the operators from input files to output tables."""
