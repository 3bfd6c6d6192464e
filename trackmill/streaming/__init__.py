"""Streams of frames and detections."""
