"""Driver-side control of jobs: lineage cuts and progressive loops."""
