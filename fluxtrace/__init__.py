"""Spark-native analytics for many simultaneous traces, label images and the events found in them."""
