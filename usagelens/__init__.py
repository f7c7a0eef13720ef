"""Subscription, usage-cost, retention and experiment analytics on Spark."""
