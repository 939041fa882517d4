"""The analyses are batch-only: there is no stream, watermark or windowed state to provide. The one
sequential rule, early stopping, is a window over simulation numbers (functions.stats)."""
