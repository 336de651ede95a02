"""Scalar functions over residues, contexts and probabilities."""
