"""Structured Streaming form of the screen: score arriving rows against a
fitted vocabulary + forest + offset (the M2/M5 predict step on new data)."""

from labelsift.streaming.screen_stream import (
    FittedScreen, fit_screen, load_screen, save_screen, screen_batch, start_screen_stream)

__all__ = ["FittedScreen", "fit_screen", "load_screen", "save_screen", "screen_batch", "start_screen_stream"]
