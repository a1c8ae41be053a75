"""Plan helpers shared by every operator: cutting lineage and size-checked broadcasts."""
