"""From feature names to one lazy plan: grammar, registry, planner, engine."""
