"""Where exchanges, audit lines and rule packs come from, and where results go."""
