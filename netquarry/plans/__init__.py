"""Registered queries; importing a module registers its queries."""

from netquarry.plans import answers, evaluations, flows, packets, state, storage, texts, trajectories  # noqa: F401
