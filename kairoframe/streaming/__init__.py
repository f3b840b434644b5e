"""The stateless stages over streams."""
