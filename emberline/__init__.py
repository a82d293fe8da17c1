"""Burst detection and summarisation of short-text streams on Spark."""

from emberline.conf import BurstConf

__all__ = ["BurstConf"]
