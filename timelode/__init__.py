"""timelode: a PySpark-native engine for longitudinal event timelines."""
