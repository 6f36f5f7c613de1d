"""Plans composed of the operators: pipeline, snapshots, lifecycle tables, engine."""
