"""Jobs that write: exports, and changes to the geofence tables."""
