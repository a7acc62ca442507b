"""Windows and state over streams of changes. Each function takes a streaming or a plain DataFrame."""
