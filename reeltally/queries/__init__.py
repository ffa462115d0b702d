"""Every operator as a registered query over the driver tables, with its oracle SQL."""
