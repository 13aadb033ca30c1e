"""Multi-step jobs: eigen / ridge solves, Tucker (HOOI), tensor regression (ALS)."""
