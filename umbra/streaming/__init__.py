"""Stream-shaped parts: progress feeds, rate limits, and live verdicts."""
