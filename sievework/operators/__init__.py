"""DataFrame operators: nominal encoding, data layouts, contingency counts, information measures, subsets."""
