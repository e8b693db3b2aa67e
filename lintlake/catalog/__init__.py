"""Configuration tables: rules, maps, thresholds.  Data only, no logic."""
