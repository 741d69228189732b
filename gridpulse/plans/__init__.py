"""Multi-step plans: silver and gold tables, interpretability, payloads, probability, map layers, checks."""
