"""Iterative plans over the operators: subset search, the selector estimator and model, the command line."""
