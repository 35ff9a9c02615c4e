"""Deliberately empty: the rebuilt system has no streaming surface.

Its polled send queues are batch queries, see ``wardflow.plans.queues``.
"""
