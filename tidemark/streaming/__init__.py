"""Online use: observations as a stream, scored with frozen parameters."""
