"""Log calls in source code, found without running it."""
