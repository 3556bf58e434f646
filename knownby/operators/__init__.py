"""DataFrame operators: point-in-time selection, series, panels, events, inference."""
