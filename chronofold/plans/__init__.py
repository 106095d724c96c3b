"""Plans that put operators together."""
