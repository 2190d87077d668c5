"""The same chains over streams."""
