"""A PySpark-native engine for ordered observation streams (detections, reads, tracks, crossings)."""
