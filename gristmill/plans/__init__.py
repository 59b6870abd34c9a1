"""Decision workflows as DataFrame programs."""
