"""Named query plans over the driver tables and their independent SQL oracles."""
