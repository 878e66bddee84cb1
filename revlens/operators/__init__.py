"""DataFrame-to-DataFrame operators of the review pipeline."""
