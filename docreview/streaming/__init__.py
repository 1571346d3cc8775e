"""Run events and live progress: Structured Streaming jobs and their batch twins."""
