"""Query operators over events, positions, cargo and geofences."""
