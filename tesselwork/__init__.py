"""tesselwork: a PySpark-native engine for spatial-evidence and text-corpus workloads."""
