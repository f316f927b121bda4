"""Sources (SRC), sinks (SNK) and filters (FLT)."""
