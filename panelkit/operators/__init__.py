"""DataFrame operators on price panels, series, events, cross-sections and text."""
