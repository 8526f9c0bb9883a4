"""Projects: sources, pipelines, checks and sinks that run as one."""
