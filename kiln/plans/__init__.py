"""Pipeline shapes (chained, fused, staged, native, repartitioned) and plan
inspection."""

from kiln.plans.pipeline import ScoringPlan

__all__ = ["ScoringPlan"]
