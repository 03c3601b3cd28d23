"""DataFrame operators: classification, folding, windows, baselines, scores, alerts."""
