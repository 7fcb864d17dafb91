"""Trend analytics over short-form content observations, on Spark DataFrames."""

from crestline.config import Config
from crestline.session import build_session

__all__ = ["Config", "build_session"]
__version__ = "0.1.0"
