"""Dataflow operators: grading, metrics, resampling, sampling, prompts, manifests."""
