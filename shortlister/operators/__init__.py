"""DataFrame operators: ranking, fusion, priors, segments, calls, preparation, classifier metrics, analysis."""
