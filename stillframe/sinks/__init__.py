"""Writers of frame results."""
