"""From source texts to facts."""
