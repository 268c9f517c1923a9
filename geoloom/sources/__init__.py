"""Where tables come from: OSM PBF files, text files of queries, and tables derived from a star schema."""
