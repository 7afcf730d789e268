"""Reading and writing pitch tables, handoff tables and models."""
