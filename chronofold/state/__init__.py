"""As-of state, checkpoints, resume and replay."""
