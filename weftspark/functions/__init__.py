"""Column functions of the graph: names, hosts, paths, identities, confidence."""
