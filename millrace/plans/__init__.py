"""Multi-stage plans: lineage cuts, components, splits, validation, tuning, experiments, workflows."""
