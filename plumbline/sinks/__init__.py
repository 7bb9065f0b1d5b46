"""Where results go: redacted, ordered, replaced whole."""
