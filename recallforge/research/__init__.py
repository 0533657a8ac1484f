"""Research routers and baselines over a bounded set of centroids, and the text tools of the data builders."""
