"""Multi-step plans: linear models, fitted models, benchmarks, season models and bundles."""
