"""Join specifications, the strategy registry, the sampled planner, evaluation and generators."""
