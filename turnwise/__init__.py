"""Quality analytics for coding-agent session transcripts, as DataFrame functions."""
